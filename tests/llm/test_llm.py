"""The training-data operators against brute force, and on nulls, empty tables, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexigauge.llm import brown, decontam, langid, licenses, linededup, neardup, packing, pii, quality, urls
from lexigauge.llm.common import components, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\n", "en", None, 4), (4, long, None, "a", 1), (5, "one two", "en", "a", 7), (5, "one two", "en", "a", 7), (None, "no id at all here", "en", "a", 3), (6, "1234 $$$", "en", "a", 8)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as row", "2 as score", "3 as same", "4 as k")


OPERATORS = [brown.score, quality.judge, pii.spans, packing.pack, linededup.report, neardup.classes, licenses.scan, langid.predict]


@pytest.mark.parametrize("op", OPERATORS, ids=lambda f: f.__module__)
def test_odd_rows_and_empty_tables(spark, odd, op):
    assert op(odd).count() >= 8
    assert op(spark.createDataFrame([], DOCS)).count() == 0


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "item_id long, text string")
    assert decontam.overlaps(odd, bench).count() == 0
    assert decontam.clean(odd, bench).count() == 8


def test_brown_base_and_norm(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = Counter()
    for i, t in rows.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(brown.tokens(t.encode()))
    total, distinct = sum(train.values()), len(train)
    got = brown.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        toks = brown.tokens(rows[r["doc_id"]].encode())
        base = sum(np.log10((train[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in toks)
        assert abs(base - r["base_score"]) < 1e-6 * abs(base)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(toks), sum(train[w] > 0 for w in toks), total)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_spaced_seeds_tolerate_substitutions_and_forms_agree(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(20)]
    rows = []
    for i, (_, t) in enumerate(items):
        w = t.split()
        for at in range(3, 30, 7):
            w[at] = "changed"
        rows.append((i, " ".join(rng.choices(vocab, k=50) + w + rng.choices(vocab, k=50))))
    rows += [(100 + i, " ".join(rng.choices(vocab, k=120))) for i in range(20)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    near = {tuple(r) for r in decontam.overlaps(d, b).collect()}
    assert {(r[0], r[1]) for r in near} == {(i, i) for i in range(20)}
    assert near == {tuple(r) for r in decontam.overlaps(d, b, broadcast_words=0).collect()}


def test_quality_base(spark, docs):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        t = r["text"]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert tuple(got[r["doc_id"]][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want


def test_mcd_rejects_a_planted_outlier(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"word{j}" for j in range(300)], k=100)), "en", "s", 0) for i in range(300)]
    rows.append((999, " ".join(x + "$$$%%%" for x in rows[0][1].split()), "en", "s", 0))
    out = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not out[999] and sum(out.values()) >= 297


def test_quality_with_many_groups_is_the_same(docs, monkeypatch):
    rows = lambda: sorted((r["doc_id"], r["kept"], r["base_failed"], round(r["outlier_d2"] or 0, 6)) for r in quality.judge(docs).collect())
    few = rows()
    monkeypatch.setattr(quality, "FEW_GROUPS", 0)
    assert rows() == few


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, rx, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_pii_base_equals_plain_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789.. -+()a@b4111") for _ in range(rng.randint(1, 60)))
        assert pii.detect(t) == brute_spans(t)


@pytest.mark.parametrize("text, kind, span", [("x john.smith [at] example [dot] com y", "email", "john.smith [at] example [dot] com"), ("mail john dot smith at example dot org", "email", "john dot smith at example dot org"), ("call plus four four two zero seven nine four six zero nine five eight ok", "phone", "plus four four two zero seven nine four six zero nine five eight"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("ip １９２.１６８.１.１!", "ip", "１９２.１６８.１.１")])
def test_pii_disguises(text, kind, span):
    base, added = pii.find(text)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in added] == [(kind, span)]


def test_pii_leaves_prose():
    assert pii.find("meet me at example.com or at noon, point by point, one two three") == ([], [])


def test_urls(spark):
    link = '<link rel="canonical" href="https://safe.example.net/a">'
    rows = [(1, "http://x.com/de/1", link), (2, "https://safe.example.net/a/", ""), (3, "http://safe.example.net/a?utm_source=f#t", None), (4, "https://y.org/b", link), (5, None, None), (6, "nonsense", "<p>"), (7, "http://EXAMPLE.org/es/q", ""), (8, "http://other.net/", '<meta http-equiv="refresh" content="0; url=http://x.com/de/9">')]
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][2] == "block" and got[4][2] == "allow"
    assert got[2][2] == got[3][2] == "allow"  # an explicitly allowed alias clears them
    assert got[5] == ("", None, "allow") and got[6] == ("", None, "allow") and got[7] == ("example.org", "example.org/es/", "block") and got[8][2] == "block"
    two = [r for r in rows if r[0] != 4]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(two, "page_id long, url string, html string")).collect()}
    assert got[2] == got[3] == "block"


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(200)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == root


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocab())
    got = packing.pack(docs).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for d in docs.collect():
        ids = np.array([*t.encode(d["text"], add_special_tokens=False).ids, 2], "<u4")
        want = [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[d["doc_id"]]) == want
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 1024
    assert len(seqs) <= -(-sum(r["length"] for r in got) // 1024) * 1.03 + 1


def test_solver_meets_the_bound_on_small_cases():
    for lengths, bins in (([600, 424, 500, 524], 2), ([512] * 4, 2), ([700, 700, 300, 300, 24, 24], 2), ([], 0), ([1024], 1)):
        assert sum(n for n, _ in packing.solve(np.bincount(lengths, minlength=1025) if lengths else np.zeros(1025, int))) == bins


def slow_line_dedup(rows):
    """doc_id to (n_links, removed) by comparing all sets."""
    place, of = {}, {}
    for doc, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            s = frozenset(line.lower().split())
            if len(s) >= linededup.LEAST_WORDS:
                place.setdefault(s, (doc, k))
                of.setdefault(doc, []).append((k, s))
    sets = list(place)
    links, near = Counter(), set()
    for i, x in enumerate(sets):
        for y in sets[:i]:
            if 5 * len(x & y) >= 4 * len(x | y):
                links.update((x, y))
                near.add(x)
    out = {doc: (0, "") for doc, _ in rows}
    for doc, lines in of.items():
        out[doc] = (sum(links[s] for s in {s for _, s in lines}), ",".join(str(k) for k, s in lines if s in near or place[s] != (doc, k)))
    return out


def test_line_dedup_equals_brute_force(docs):
    want = slow_line_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = linededup.report(docs).collect()
    assert {r["doc_id"]: (r["n_links"], r["removed"]) for r in got} == want
    assert len(got) == len(want) and sum(n for n, _ in want.values())


def test_line_dedup_loses_no_link_in_a_large_group(spark):
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(20)], []
    for k in range(120):
        w = list(base)
        w[rng.randrange(20)], w[rng.randrange(20)] = f"x{k % 90}", f"y{k % 40}"
        rows.append((k, " ".join(w) + "\n" + " ".join(rng.choices(base, k=7))))
    rows += [(500, rows[0][1]), (501, rows[0][1])]
    got = linededup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_links"], r["removed"]) for r in got} == slow_line_dedup(rows)
    assert {r["class_id"] for r in got if r["doc_id"] in (0, 500, 501)} == {0}


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    rows, want = [], {}
    for g in range(12):
        base = rng.choices(words, k=200)
        for k in range(6):
            w = list(base)
            if k:
                w[rng.randrange(200)] = f"x{g}{k}"
            rows.append((10 * g + k, " ".join(w)))
            want[10 * g + k] = 10 * g
    rows += [(500, rows[0][1]), (501, "short text"), (502, "short text"), (503, "")]
    want |= {500: 0, 501: 501, 502: 501, 503: 503}
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_probability_jaccard_and_its_estimate():
    def slow(a, b):
        total = lambda d: {k: v / sum(d.values()) for k, v in d.items()}
        x, y = total(a), total(b)
        return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x.keys() & y.keys())

    rng = random.Random(6)
    a = {k: rng.randint(1, 5) for k in range(400)}
    b = {k: rng.randint(1, 5) if k > 380 else v for k, v in a.items()} | {k: 1 for k in range(400, 440)}
    arr = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], float))
    exact = neardup.similarity(*arr(a), *arr(b))
    assert abs(exact - slow(a, b)) < 1e-9
    h = lambda d: neardup._mix(np.array(sorted(d), np.uint64) + np.uint64(99))
    sig = neardup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([h(a), h(b)]), np.concatenate([arr(a)[1], arr(b)[1]]), 2)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.15


def test_licences_plan_equals_plain_scoring(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Fishing requires a license from the state.", "Er kam mit dem Rad."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    for r in licenses.paragraphs(docs).collect():
        assert abs(licenses.predict(r["paragraph"])[1] - r["p"]) < 1e-9
    got = {r["doc_id"]: r["families"] for r in licenses.scan(docs).collect()}
    assert got == {0: "MIT", 1: "CC-BY-NC", 2: "Apache", 3: "GPL", 4: "", 5: ""}


def test_crf_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    emit, trans, first = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, log_z = langid.marginals(emit, np.array([0]), np.array([5]), trans, first)
    total, want = 0.0, np.zeros((5, 3))
    for y in itertools.product(range(3), repeat=5):
        w = np.exp(first[y[0]] + sum(emit[t, y[t]] for t in range(5)) + sum(trans[y[t], y[t + 1]] for t in range(4)))
        total += w
        want[range(5), y] += w
    assert np.allclose(post, want / total, atol=1e-5) and abs(log_z[0] - np.log(total)) < 1e-6


def test_language_words_are_letters_with_their_marks(spark):
    assert langid.words("½ ² ③ Ⅷ x2y हिन्दी Été \U00010400") == ["x", "y", "हिन्दी", "été", "\U00010428"]
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("die katze sitzt auf der matte", "de")] * 30)]
    rows += [(900, "½ ² ③", None, "s", 1), (901, None, None, "s", 1), (902, "12 !!", None, "s", 1)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0) and {got[0][0], got[1][0]} == {"en", "de"}


def test_language_held_out(spark, docs):
    out = langid.predict(docs).collect()
    held = [r for r in out if r["held_out"] and r["n_words"] >= 5]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()

"""Nulls, empty and blank texts, ties, repeats, long runs and clashing columns: whole rows by value, and the pipeline as a whole."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexigauge.llm import brown, langid, licenses, linededup, neardup, packing, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG, BLANKS = "x" * 200_000, " " * 199_998 + "\n\n"
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t\n", "en", None), (4, "one two", "en", "a"), (4, "one two", "en", "a"), (None, "no id at all, at all", "en", "a"), (6, "1234 $$$", "en", "a"), (7, LONG, "fr", "b"), (8, BLANKS, None, "b"), (9, "a b c d e a b c d e\na b c d e a b c d e\n\na B", "en", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as row", "2 as score", "3 as same", "4 as k", "5 as bucket", "6 as word", "7 as `a.b`")


def told(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def each(f):
    return sorted(((i, *f(t or "")) for i, t, _, _ in ROWS), key=str)


def test_scores(odd):
    train = Counter()
    for i, t, _, _ in ROWS:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*WORD.findall((t or "").lower()), " "])
    total, kinds = sum(train.values()), len(train)
    want = {}
    for i, t, _, _ in ROWS:
        w = [*WORD.findall((t or "").lower()), " "]
        want[i] = (i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(train[x] > 0 for x in w), total, sum(np.log10((train[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w))
    got = brown.score(odd).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4]) and r["score"] < 0


def test_brown_model_sums_to_one(spark, monkeypatch):
    """What every class says of all known words and the unknown one, and a text's score by hand."""
    rng, held = random.Random(2), {}
    real = brown._scored

    def seen(words, model):
        held["words"], held["model"] = words.value, model.value
        return real(words, model)

    monkeypatch.setattr(brown, "_scored", seen)
    vocabulary = [f"w{i}{chr(97 + i % 7)}" for i in range(300)]
    texts = [(i, " ".join(vocabulary[int(rng.paretovariate(0.7)) % 300] for _ in range(40))) for i in range(200)] + [(1000, "never seen before w0a")]
    scores = {r["doc_id"]: r["score"] for r in brown.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    w, (cls, step, unknown, emit, _) = held["words"], held["model"]
    live = [c for c in range(brown.CLASSES) if (cls == c).any()]
    for c in live:
        total = (10.0 ** (step[c, cls[w.unit]] + emit)).sum() + 10.0 ** unknown[c]
        assert total == pytest.approx(1.0, abs=1e-9)
    for i, text in texts[:20] + texts[-1:]:
        before, want = 0, 0.0
        for token in brown.tokens(text.encode()):
            (core,), (unit,) = w.look([token])
            want += step[cls[before], cls[unit]] + emit[core] if core >= 0 else unknown[cls[before]]
            before = unit
        assert scores[i] == pytest.approx(want)


def test_quality(odd):
    def plain(text):
        w = WORD.findall(text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        often = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(often) > 20 * len(w)
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(often), failed, not failed

    assert told(quality.judge(odd), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == each(plain)


def test_pii(odd):
    none = hashlib.sha256(b"").hexdigest()
    assert told(pii.spans(odd), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == each(lambda t: (0, 0, 0, 0, none, ""))


def test_packing(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocab())
    got, want = packing.pack(odd).collect(), []
    for i, text, _, _ in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids)))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        assert [a for a, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024


def test_lines_and_copies(odd):
    got = {(r[0]): tuple(r)[1:] for r in linededup.report(odd).select("doc_id", "class_id", "n_lines", "n_links", "n_exact", "n_removed", "removed").collect()}
    assert got == {1: (1, 0, 0, 0, 0, ""), 2: (2, 1, 0, 0, 0, ""), 3: (3, 3, 0, 0, 0, ""), 4: (4, 1, 0, 0, 0, ""), None: (None, 1, 0, 0, 0, ""), 6: (6, 1, 0, 0, 0, ""), 7: (7, 1, 0, 0, 0, ""), 8: (8, 3, 0, 0, 0, ""), 9: (9, 4, 0, 1, 1, "1")}
    kept = sorted((tuple(r) for r in neardup.dedup(odd).select("doc_id", "text").collect()), key=str)
    assert kept == sorted({(i, t) for i, t, _, _ in ROWS}, key=str)


def test_licences(odd):
    count = lambda t: (sum(bool(WORD.search(x)) for x in t.split("\n")), 0, 0, 0, "", "")
    assert told(licenses.scan(odd), "doc_id", "n_lines", "n_candidates", "n_licence", "n_unknown", "families", "uses") == each(count)


def test_languages(odd):
    got = langid.predict(odd.select("doc_id", "text", "lang")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (1, 2, 3, 6, 8):
            assert (r["lang_pred"] == "und") == (r["doc_id"] != 6 or not re.search("[a-z]", "1234 $$$")), r


def test_pipeline_as_a_whole(spark, tmp_path):
    """Two languages; what must go goes, what is clean stays whole."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    words = {"en": ["the", "house", "with", "water", "through", "thing", "which", "other"], "fr": ["été", "être", "où", "garçon", "français", "île", "août", "fenêtre"]}
    line = lambda lang, i: " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "ment" if lang == "fr" else "ing"]) + ("" if j % 4 else chr(97 + (i * 7 + j) % 26) + chr(97 + (i // 26 + j * 3) % 26)) for j in range(40))
    rows = [(i, line(lang := ("en", "fr")[i % 2], i), lang, "s", 1) for i in range(60)]
    passage = " ".join(f"item{'abcdefghij'[k]}{'klmnopqrst'[k]}" for k in range(10)) + " " + line("en", 777)
    clean = {r[0]: r[1] for r in rows}
    shared = line("fr", 999)
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, " \n ", None, "s", 3), (103, "12 34 $$", "en", "s", 8)]  # no letter
    rows += [(104, rows[7][1], "fr", "s", 1), (105, rows[7][1], "fr", "s", 1)]  # copies
    rows += [(106, f"{line('en', 300)} {passage} {line('en', 301)}", "en", "s", 1)]  # a benchmark passage
    rows += [(107, f"{line('fr', 400)}\n{shared}", "fr", "s", 1), (108, f"{line('fr', 401)}\n{shared}", "fr", "s", 1)]  # a shared line
    clean |= {107: rows[-2][1], 108: rows[-1][1].split("\n")[0]}
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t, want = Tokenizer.from_file(packing.default_vocab()), []
    for i, text in clean.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids)))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)

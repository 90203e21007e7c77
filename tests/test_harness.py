"""Whole results against plain code, and the cases their queries don't reach."""

import random

import pytest
from pyspark.sql import functions as F

from lexigauge.functions import names
from lexigauge.operators import extraction, harness


def test_survival(spark):
    rng = random.Random(9)
    gold = [(rng.choice("AB"), f"Q{rng.randrange(12)}", rng.randrange(300), rng.choice([0, 1, 2, 90])) for _ in range(60)]
    pred = [(rng.choice("AB"), rng.randrange(300), rng.choice([0, 1, 3, 70]), rng.choice([None, *(f"Q{i}" for i in range(12))]), rng.choice([None, [], [f"Q{rng.randrange(12)}" for _ in range(5)]])) for _ in range(80)]
    got = {r["metric"]: (r["matched"], r["total"]) for r in harness.survival_rates(spark.createDataFrame(gold, "title string, qid string, idx int, span int"), spark.createDataFrame(pred, "title string, idx int, span int, qid string, cands array<string>")).collect()}
    count = dict.fromkeys(("rec", "found", "ok", "direct", "miss"), 0)
    entities = {(t, q) for t, q, _, _ in gold}
    for t, q in entities:
        hits = [p for p in pred if p[0] == t and any(g[2] < p[1] + p[2] and p[1] < g[2] + g[3] for g in gold if g[:2] == (t, q))]
        found, direct = any(q in (p[4] or []) for p in hits), any(p[3] == q for p in hits)
        for k, v in {"rec": bool(hits), "found": found, "ok": found and direct, "direct": direct, "miss": direct and not found}.items():
            count[k] += v
    linked = {(p[0], p[3]) for p in pred if p[3]}
    n = len(entities)
    assert got == {"R_NER": (count["rec"], n), "R_search": (count["found"], count["rec"]), "A_disamb": (count["ok"], count["found"]), "R": (count["ok"], n), "R_direct": (count["direct"], n), "P": (len(linked & entities), len(linked)), "miss": (count["miss"], n)}
    assert count["miss"] and count["ok"]


def test_paired_rows_must_match(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "n int, a string")
    b = spark.createDataFrame([(1, "v"), (0, "u")], "n int, b string")
    assert sorted(map(tuple, harness.paired_rows(a, b, "n").collect())) == [(0, "x", "u"), (1, "y", "v")]
    for other in (b.limit(1), b.union(b.limit(1)), b.union(spark.createDataFrame([(2, "w")], b.schema))):
        with pytest.raises(Exception, match="match"):
            harness.paired_rows(a, other, "n").collect()


def test_params_a_model_takes(spark):
    models = spark.createDataFrame([("m", True, False, True, True, "effort"), ("t", False, True, False, False, "max_tokens"), ("q", True, True, True, False, "enable_thinking")], "model string, temperature boolean, top_k boolean, min_p boolean, seed boolean, reasoning string")
    every = {"temperature": "1", "top_k": "2", "min_p": "3", "seed": "9", "reasoning.effort": "low", "reasoning.max_tokens": "5", "enable_thinking": "true", "max_tokens": "8"}
    rows = spark.createDataFrame([(i, m, every) for i, m in enumerate(["m", "t", "q", "unknown"])], "id int, model string, params map<string,string>")
    got = {r["model"]: set(r["params"].items()) for r in harness.supported_params(rows, models).collect()}
    keep = lambda *k: {(x, every[x]) for x in k}
    assert got == {
        "m": keep("temperature", "min_p", "reasoning.effort", "max_tokens") | {("seed", "7")}, "t": keep("top_k", "reasoning.max_tokens", "max_tokens"),
        "q": keep("temperature", "top_k", "min_p", "enable_thinking", "max_tokens"), "unknown": set(every.items()),
    }


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, gold_difficulty string, gold_pair string, pred_pair string, gold_recommended string, pred_recommended string")
    assert harness.pairing_scores(none, "k").count() == 0
    red = spark.createDataFrame([("k", "red", None, None, None, None), ("k", "red", None, "green", None, None)], none.schema)
    assert tuple(harness.pairing_scores(red, "k").first()) == ("k", 0, 0.0, 0.5, None, 0)
    assert harness.latency(spark.createDataFrame([("a", 1.25), ("a", None)], "k string, v double"), "k", "v").collect()[0]["p50"] == 1.3


@pytest.mark.parametrize("f, said, want", [
    (names.title_case, "  new \t york ", "New York"), (names.title_case, " ", None), (names.language, " RU ", "Russian"), (names.language, "Old Slavic ", "Old Slavic"), (names.language_label, "uk", "Ukrainian"), (names.language_label, "xx-A1", "xx-A1"), (names.language_label, "", ""),
    (names.on_one_line, "a\x00b\n c\x7f\td ", "ab c d"), (names.without_label, " TRANSLATION : x: y ", "x: y"), (names.without_wrapping, "```\nab\n```", "ab"), (names.without_wrapping, '"', '"'), (names.without_wrapping, "“a\"", "a"),
    (names.document_slug, "Привет!", "document"), (names.file_name, "Aé/ё b.c-d_1", "Aé_ё_b.c-d_1"), (names.pictures_marked, "x ![a](b) y", "x <picture> y"), (names.storage_name, "a/b:c", "a__b_c"),
])
def test_names(spark, f, said, want):
    assert spark.createDataFrame([(said,)], "c string").select(f(F.col("c"))).first()[0] == want


def test_capitals_and_arrays_on_long_texts():
    blanks = " " * 500
    assert extraction.capitalised(f"Город.{blanks}Аккад стоял у Ура") == ["Ура"]
    assert extraction.capitalised("Аккад. (Ур) Киш") == ["Ур"]  # what follows a bracket and a blank opens a sentence
    assert extraction.first_array('x [1 "]" [2, "]"] y') == '[2, "]"]' and extraction.first_array("[[") is None
    text = "Слово и дело. " * 40_000
    assert len(extraction.sentences(text)) == 40_000


def test_deterministic_terms(spark):
    from lexigauge.functions import forms

    rng = random.Random(3)
    words = ["Аккад", "Ур", "город", "царь", "египтяне", "финикийцы", "и", "Кадашман-Харбе", "Урук", "молодцы"]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "!"]) for _ in range(rng.randint(0, 14)))) for i in range(80)] + [(900, None), (901, "")]
    lexicon = [("царь", "title"), ("город", "place"), ("Ур", "place")]
    df = spark.createDataFrame(texts, "id int, text string")
    listed = {r["id"]: [(x["surface"], x["category"]) for x in r["g"]] for r in df.select("id", forms.gazetteer(F.coalesce("text", F.lit("")), lexicon).alias("g")).collect()}
    want = []
    for i, t in texts:
        kinds = dict.fromkeys(extraction.capitalised(t or ""))
        for surface, category in listed[i]:
            kinds.setdefault(surface, category)
        taken = set()
        for surface in sorted(kinds, key=len, reverse=True):
            at = (t or "").find(surface)
            while at >= 0:
                here = set(range(at, at + len(surface)))
                if not here & taken:
                    taken |= here
                    want.append((i, at, at + len(surface), surface, kinds[surface]))
                at = t.find(surface, at + len(surface))
    got = [tuple(r) for r in extraction.deterministic(df, "id", lexicon).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x[4] for x in want} == {None, "title", "place", "people"}


def test_both_sides_are_read_once(spark):
    gold = spark.createDataFrame([("A", "q", 1, 2), (None, "q", 1, 2), ("A", "r", 1, 2)], "title string, qid string, idx int, span int")
    rows = [("A", 1, 1, "x", ["q"], 3), ("A", 1, 1, "q", ["q"], 5), ("A", 1, 1, "z", None, None), (None, 1, 2, "q", ["q"], 1), ("A", None, 1, "r", None, 2)]
    pred = spark.createDataFrame(rows, "title string, idx int, span int, qid string, cands array<string>, id int")
    got = {r["metric"]: (r["matched"], r["total"]) for r in harness.survival_rates(gold, pred).collect()}
    assert got == {"R_NER": (2, 3), "R_search": (1, 2), "A_disamb": (1, 1), "R": (1, 3), "R_direct": (1, 3), "P": (2, 5), "miss": (0, 3)}
    plan = harness.survival_rates(gold, pred)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # predictions were read twice, once more for what they name


def test_strict_folds_once(spark):
    from lexigauge.operators import matching

    gold = spark.createDataFrame([("A", 1, "STRASSE", "q", 1), ("A", 2, "x", "q", 1), ("A", 3, None, "q", 1)], "title string, idx int, surface string, qid string, span int")
    pred = spark.createDataFrame([("A", 1, "straße", "q", 2), ("A", 2, "y", "q", 1), ("A", 3, None, "q", 1)], gold.schema)
    out = matching.strict(gold, pred)
    assert sorted((r["side"], r["surface"]) for r in out.collect()) == [("gold", "STRASSE"), ("pred", "straße")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_mentions_word_by_word(spark, tmp_path):
    import re

    from lexigauge.sources import tables

    texts = [None, "", " ", "Abcdef abcdefg  Äbcdefgh É1bcdefghijk\nLonger-words (Parens) ", "K" * 7 + "K " + "İstanbul-City", "abcdefghij " * 5000]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for which in ("gold", "pred"):
        want = []
        for i, t in enumerate(texts):
            for k, w in enumerate((t or "").split(" ")):
                q = re.sub("[^A-Za-z]", "", w).lower()
                n = len(q)
                if n > 5 and (re.match("[A-Z]", w) if which == "gold" else n % 2 == 1 or n > 9):
                    want.append((i, k, w, q) if which == "gold" else (i, k - (n % 5 == 0), w, q))
        got = tables.mentions(spark, str(tmp_path), which)
        assert sorted(tuple(r) for r in got.select("title", "idx", "surface", "qid").collect()) == sorted(want)
        assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()  # the letters of a word were picked up to five times

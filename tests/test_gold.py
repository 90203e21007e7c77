"""Pages as gold mentions, extraction rules, text rules, on own small cases."""

import pytest
from pyspark.sql import functions as F

from lexigauge.functions import text as T
from lexigauge.operators import anchors, evaluation, extraction, spans


def test_anchors(spark):
    html = """<div class="infobox"><p>No <a href="./Box">box</a></p></div><p>See&nbsp;<a href="./Big_city#top">big city</a> and [<a href="./S">s</a>]
      <a href="https://x.org/">out</a><sup class="reference"><a href="./R">1</a></sup><a href="/wiki/File:p.png">pic</a> <a href="./Gone">gone</a>
      <table><tr><td><p>cell</p></td></tr></table><p>In <a href="./1066">1066</a>, <a href="./Bare">bare</a> big city<script>var p = "<p>x</p>";</script></p>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    titles = spark.createDataFrame([("Big city", "City", "Q1", ["Q5"]), ("1066", "1066", "Q2", ["Q578"]), ("Bare", "Bare", None, [])], "title string, canonical string, qid string, classes array<string>")
    found = anchors.found(pages, "page_id", "html")
    rows = anchors.resolved(found, titles, "page_id").orderBy("place").collect()
    assert [(r["surface"], r["fate"]) for r in rows] == [("big city", "gold"), ("s", "symbol"), ("out", "nonmain"), ("pic", "nonmain"), ("gone", "redlink"), ("1066", "chrono"), ("bare", "no_qid")]
    assert (rows[0]["token_index"], rows[0]["span"], rows[0]["qid"], rows[0]["page_id"]) == (1, 2, "Q1", 1)
    c = anchors.counters(anchors.resolved(found, titles, "page_id"), "page_id").collect()
    assert len(c) == 1 and c[0].asDict() == {"page_id": 1, "n_anchors": 4, "n_no_qid": 1, "n_redlink": 1, "n_excluded_chrono": 1, "n_excluded_nonmain": 2, "n_excluded_symbol": 1, "n_gold": 1}
    flat = {r["page_id"]: r["text"] for r in anchors.flattened(pages, "page_id", "html").collect()}
    assert flat[2] == flat[3] == "" and "box" not in flat[1] and "cell" not in flat[1] and flat[1].startswith("See big city and [s]")


def test_sentences_and_context():
    t = "В 44 г. до н. э. пал Цезарь. А. С. Пушкин писал! Он жил в XIX в. и т. д. Конец… Всё"
    assert [t[a:b] for a, b in extraction.sentences(t)] == ["В 44 г. до н. э. пал Цезарь.", "А. С. Пушкин писал!", "Он жил в XIX в. и т. д. Конец…", "Всё"]
    at = t.index("писал")
    assert extraction.context(t, at, at + 5) == "А. С. Пушкин писал!"
    assert extraction.context(t, at, t.index("XIX") + 3).startswith("А. С.") and extraction.context("ab.  C", 3, 5) == ""
    assert extraction.sentences("") == [] and extraction.capitalised("Он видел Рим и Кадашман-Харбе. Город Рим. Марк Антоний ушёл") == ["Рим", "Кадашман-Харбе", "Город Рим", "Марк Антоний"]


def test_replies():
    assert extraction.first_array('x [1, "a]b\\"]", [2]] y [3]') == '[1, "a]b\\"]", [2]]'
    assert extraction.first_array("[ [1]") == "[1]" and extraction.first_array("none") is None
    got = extraction.parse('```json\n[{"surface": " Рим ", "category": "place"}, {"surface": ""}, 5, {"surface": "Ур", "lemma": "a\\nb", "category": "odd"}]\n```')
    assert got == [{"surface": "Рим", "lemma": "Рим", "category": "place", "category_raw": None}, {"surface": "Ур", "lemma": "Ур", "category": "other", "category_raw": "odd"}]
    assert extraction.parse("[1,") is None and extraction.parse("[]") == [] and extraction.parse(None) is None
    kept, dropped = extraction.valid("Рим Рим", [*got, got[0]])
    assert [x["surface"] for x in kept] == ["Рим"] and dropped == 1


def test_claims_step_past_whole_occurrences():
    assert spans.claimed("Xaaaa", ["Xa", "aa"]) == [(0, 2, "Xa"), (3, 5, "aa")]


def test_text_rules(spark):
    md = "```py\r\ncode\r\n```\n# Head\n> quote\n- item\n---\n| a | b |\n|---|:-:|\n| 1 | **2** |\n![i](u)[t](v) <b>x</b> __y__ *z* `c`\n\n\n\nend"
    df = spark.createDataFrame([(md, "use it", "./A+B%20c_d#e"), ("plain", "either 'a' / 'b'", "/wiki/Категория:X"), (None, "'a', 'b'", "Bare"), ("", "an honest phrase", "./")], "md string, s string, href string")
    rows = df.select(T.strip_markdown(F.col("md")).alias("m"), T.is_advice(F.col("s")).alias("a"), T.link_title(F.col("href")).alias("t"), T.norm(F.col("md")).alias("n")).collect()
    assert [r["m"] for r in rows[1:]] == ["plain", None, ""] and [r["a"] for r in rows] == [True, True, False, False]
    assert rows[0]["m"].split("\n") == ["code", "", "Head", "quote", "- item", "", "a — b", "1 — 2", "t x y z c", "", "end"]
    assert [r["t"] for r in rows] == ["A+B c d", None, None, ""] and rows[2]["n"] is None
    assert T.norm_text(" Ёж−é  STRAßE ") == "еж-é strasse"


@pytest.mark.parametrize("rows, want", [([("green", "green", "green", "A ", "a"), ("green", "green", "red", "b", "b"), ("red", None, None, None, None), ("red", None, "green", None, None)], (2, 0.5, 1.0, 1))])
def test_pairing(spark, rows, want):
    df = spark.createDataFrame(rows, "gold_difficulty string, gold_pair string, pred_pair string, gold_recommended string, pred_recommended string")
    assert tuple(evaluation.pairing(df).first()) == want

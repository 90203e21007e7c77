"""Resumed runs, files by position, reports."""

import json

import pytest
from pyspark.sql import functions as F

from lexigauge.operators import reports
from lexigauge.sources import positional, resume


@pytest.fixture
def units(spark):
    return spark.createDataFrame([(f"u{i:02}", 100 - i) for i in range(30)], "unit string, place int")


def answer(df):
    n = F.substring("unit", 2, 2).cast("int")
    rows = df.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1)))).where((n % 7 != 6) | (F.col("r") == 0))
    return rows.select("unit", (n % 10 != 9).alias("ok"), (n * 10 + F.col("r")).alias("score")).where(n % 11 != 10)


def told(df):
    return sorted(map(tuple, df.collect()))


def test_killed_and_resumed_equals_one_run(spark, units, tmp_path):
    whole = told(resume.resumed(units, "unit", "place", answer, f"{tmp_path}/one", ["score"]))
    calls = []

    def dies(df):
        calls.append(1)
        if len(calls) in (2, 4):
            raise RuntimeError("killed")
        return answer(df)

    path = f"{tmp_path}/two"
    for _ in range(9):
        try:
            got = told(resume.resumed(units, "unit", "place", dies, path, ["score"], waves=3))
            break
        except RuntimeError:
            (tmp_path / "two" / "attempt=77").mkdir(parents=True, exist_ok=True)  # a write that was cut off
    assert got == whole
    assert {p: s for p, u, s in whole if u == "u09"} == {91: None}  # failed three times
    assert {p: s for p, u, s in whole if u == "u10"} == {90: None}  # no row, three times
    assert [s for _, u, s in whole if u == "u03"] == [30, 31] and [s for _, u, s in whole if u == "u06"] == [60]
    before = len(calls)
    assert told(resume.resumed(units, "unit", "place", dies, path, ["score"], waves=3)) == whole and len(calls) == before
    rows = resume.Run(spark, path).rows()
    assert resume.pending(units, rows, "unit").count() == 0
    assert {r["failures"] for r in resume.ranked_failures(rows, "unit").where("unit = 'u09'").collect()} == {1, 2, 3}
    assert resume.resumed(units.limit(0), "unit", "place", answer, f"{tmp_path}/none", ["score"]).count() == 0


def test_numbered_lines_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) if i % 6 else "  " for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = sorted(map(tuple, positional.numbered_lines(spark, f"{tmp_path}/a.txt").collect()))
        every = positional.numbered_lines(spark, f"{tmp_path}/a.txt", skip_blank=False).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(x for x in lines if x.strip())) and every == 4000


def test_systems_are_zipped_or_refused(spark, tmp_path):
    top = tmp_path / "s"
    (top / "metricx").mkdir(parents=True)
    (top / "comet").mkdir()
    put = lambda name, rows: (top / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    put("scores.jsonl", [{"accuracy": i, "fluency": None if i == 2 else i / 2} for i in range(5)])
    put("metricx/scores.jsonl", [{"prediction": i + 0.5} for i in range(5)])
    put("metricx/scores_wo_ref.jsonl", [{"prediction": -i} for i in range(5)])
    (top / "comet/scores.json").write_text(json.dumps({"system_score": 1, "paragraph_scores": [0.1 * i for i in range(5)]}, indent=1))
    got = sorted(map(tuple, positional.system_scores(spark, str(tmp_path), "s").collect()))
    assert got[2] == (2, 2.0, None, None, 2.5, -2.0, pytest.approx(0.2)) and len(got) == 5
    put("metricx/scores.jsonl", [{"prediction": 1}])
    with pytest.raises(ValueError, match="metricx/scores.jsonl"):
        positional.system_scores(spark, str(tmp_path), "s")


def test_gold_and_mentions(spark, tmp_path):
    (tmp_path / "gt.jsonl").write_text('{"title": "B", "stratum": "x", "gt_tuples": [[3, "Ur", "Q1", 1], [5, "of", "Q2", 2]]}\n\n{"title": "A", "gt_tuples": []}\n{"title": "C", "gt_tuples": [[0, "c", "Q3", 1]]}\n')
    got = positional.gold_articles(spark, f"{tmp_path}/gt.jsonl").orderBy("place", "index").collect()
    assert [tuple(r) for r in got] == [("B", "x", 0, 3, "Ur", "Q1", 1), ("B", "x", 0, 5, "of", "Q2", 2), ("C", None, 2, 0, "c", "Q3", 1)]
    (tmp_path / "m.jsonl").write_text('{"paragraph_id": 1, "surface": "b"}\n{"paragraph_id": 1, "surface": "a", "lang": "en", "char_start": 4}\n')
    (row,) = positional.mentions(spark, f"{tmp_path}/m.jsonl").collect()
    assert [(m["surface"], m["context"], m["char_start"], m["lang"]) for m in row["mentions"]] == [("b", "", -1, "ru"), ("a", "", 4, "en")]
    (tmp_path / "p.jsonl").write_text('{"title": "B", "index": 3, "qid": null, "candidates": [{"qid": "Q1", "label": "x"}]}\n')
    assert positional.predictions(spark, f"{tmp_path}/p.jsonl").first()["candidates"][0]["qid"] == "Q1"


def test_reports(spark):
    docs = spark.createDataFrame([(1, "T|", "ru", "en"), (2, None, "ru", "en")], "doc_id int, title string, source_lang string, target_lang string")
    rows = spark.createDataFrame([(1, 1, "b", None), (1, 0, "a|c\r\nd", "x\ny")], "doc_id int, place int, source string, target string")
    got = {r["doc_id"]: r["markdown"] for r in reports.markdown(docs, rows).collect()}
    head = "\n\n| ¶ | Source (ru) | Translation (en) |\n|---|---|---|\n"
    assert got == {1: f"# T|{head}| 1 | a\\|c<br>d | x<br>y |\n| 2 | b |  |\n", 2: f"# {head}"}
    cells = spark.createDataFrame([("term<", 12, 0.5, 0.25, 0.75), ("named", 40, None, 0.0, 1.0)], "cls string, n int, r double, lo double, hi double")
    made = reports.html_rows(cells, ["cls", "n"], {"r": ("lo", "hi", "n")})
    page = reports.html(made, ["class", "n", "R"], ["cls"], "A & B", {"model": "<m>"}).first()["html"]
    assert page.index("named") < page.index("term&lt;") and "A &amp; B" in page and "<code>&lt;m&gt;</code>" in page
    assert page.count("underpowered") == 1 and "<td>–" in page and "0.5000" in page

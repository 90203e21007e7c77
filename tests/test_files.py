import pytest

from lexigauge.sources import files


def test_json_lines_go_round(spark, tmp_path):
    df = spark.createDataFrame([(2, "б"), (1, None)], "id long, text string")
    files.write_jsonl(df, str(tmp_path / "a"), ["id"])
    assert [tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "a"), "id long, text string").orderBy("id").collect()] == [(1, None), (2, "б")]
    with pytest.raises(ValueError):
        files.write_guarded(df, 1, str(tmp_path / "b"), ["id"])
    assert files.write_guarded(df, 0, str(tmp_path / "b"), ["id"]) == 2


def test_titles_and_paragraphs(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("One\tlong\nTwo\n\nThree\t\n")
    assert sorted(tuple(r) for r in files.read_titles(spark, str(tmp_path / "t.tsv")).collect()) == [("One", "long"), ("Three", "typical"), ("Two", "typical")]
    (tmp_path / "c.md").write_text("# Head\n\nfirst\n \nsecond\nline\n\n")
    assert [(r["idx"], r["text"]) for r in files.read_paragraphs(spark, str(tmp_path / "c.md")).collect()] == [(0, "first"), (1, "second\nline")]


def test_decoding(spark):
    from pyspark.sql import functions as F

    rows = [(bytearray("дом".encode()),), (bytearray("дом, ёж".encode("cp1251")),), (bytearray("ok\x01\x02".encode()),)]
    assert [r[0] for r in spark.createDataFrame(rows, "b binary").select(files.decode_text(F.col("b"))).collect()] == ["дом", "дом, ёж", None]

"""Stages on tables with extra columns of clashing or dotted names, and on empty tables."""

import pytest
from pyspark.sql import functions as F

from lexigauge.llm import decontam, langid, linededup, neardup

DOCS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank", "en"),
    (2, "eins zwei drei vier alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "de"),
    (3, None, None),
    (4, "", "en"),
    (5, "½ ²", None),
]
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
EXTRA = {"a.b": 1, "a`c": 2, "_id": "x", "_cut": 3, "_kept": True, "_text": "t", "score": 0.5, "lang_pred": "zz", "held_out": 7, "row": 8, "n": 9, "h": 10, "class_id": 11}


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame([(*r, "s") for r in DOCS], "doc_id long, text string, lang string, source string")
    return d.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items()])


def kept(out, docs):
    """Ids of the rows; every other value must be as it came."""
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[len(docs.columns) - len(EXTRA) :] == tuple(EXTRA.values()) for r in rows)
    return sorted(r[0] for r in rows)


def bench(spark):
    return spark.createDataFrame([(1, ITEM)], "item_id long, text string")


def test_decontamination(spark, docs):
    assert kept(decontam.clean(docs, bench(spark), min_words=8), docs) == [1, 3, 4, 5]
    assert decontam.clean(docs.limit(0), bench(spark)).count() == 0


@pytest.mark.parametrize("stage", [linededup.dedup, neardup.dedup])
def test_dedup_keeps_different_texts(docs, stage):
    assert {1, 2} <= set(kept(stage(docs), docs))
    assert stage(docs.limit(0)).count() == 0


def test_language_hides_only_its_own_columns(docs):
    out = langid.predict(docs)
    mine = ["held_out", "lang_pred", "score", "n_words", "second", "n_switches"]
    assert set(out.columns) == set(docs.columns) | set(mine)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (3, 4, 5))
    assert rows[1]["lang_pred"] != "und" and all(r["a.b"] == 1 and r["a`c"] == 2 and r["row"] == 8 for r in rows.values())
    assert langid.predict(docs.limit(0)).count() == 0

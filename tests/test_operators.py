"""Rules that the driver's tables don't reach, on small literals."""

from pyspark.sql import functions as F

from lexigauge.functions import text as T
from lexigauge.operators import matching, scores, shaping, stats


def test_redirect_cycle_stops_before_a_seen_title(spark):
    red = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = shaping.redirect_chain(spark.createDataFrame([("a",), ("x",), ("z",)], "title string"), red)
    assert {tuple(r) for r in got.collect()} == {("a", "c", 2), ("x", "y", 1), ("z", "z", 0)}


def test_span_floor(spark):
    g = spark.createDataFrame([("t", 3, "s", "q", 0)], "title string, idx int, surface string, qid string, span int")
    assert matching.overlapping(g, g).count() == 1
    assert matching.overlapping(g, g, same_entity=False, floor=0).count() == 0


def test_wilson_of_none(spark):
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 1.0)


def test_spearman_needs_two_and_variation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 5.0), ("c", 2.0, 7.0)], "k string, x double, y double")
    assert {r["k"]: r["rho"] for r in stats.spearman(df, "k", "x", "y").collect()} == {"a": None, "b": None, "c": 1.0}


def test_carry_forward_skips_disabled(spark):
    c = spark.createDataFrame([("a", 0.0, 10.0, 1, True), ("b", 0.0, 10.0, 1, True), ("z", 0.0, 10.0, 9, False)], "crit string, lo double, hi double, weight int, enabled boolean")
    s = spark.createDataFrame([(1, "a", 5.0, 1, 1), (1, "z", 9.0, 2, 2), (1, "b", 10.0, 3, 3)], "para int, crit string, value double, ts int, id int")
    assert {(r["ts"], r["aggregate"]) for r in scores.carry_forward(s, c).collect()} == {(1, 5.0), (3, 7.5)}


def test_text_rules(spark):
    d = spark.createDataFrame([("  a b", "Use it", "File:x", "LOUD LINE", "a\nb")], "t string, s string, h string, l string, m string")
    r = d.select(T.token_index(F.col("t"), F.lit(4)).alias("i"), T.is_advice(F.col("s")).alias("a"), T.link_title(F.col("h")).alias("h"), T.is_body(F.col("l")).alias("b"), T.lemma_or_surface(F.col("m"), F.lit("x")).alias("m")).first()
    assert tuple(r) == (2, True, None, False, "x")

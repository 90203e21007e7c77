"""Decisions on odd input: nulls, empty tables, ties, and numbering across blocks."""

from pyspark.sql import functions as F

from lexigauge.operators import decisions


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_gates_keep_what_is_unknown(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    none, year = F.lit(None).cast("array<string>"), lambda y: F.lit(y).cast("int")
    assert one(spark, decisions.gated(none, year(None)), decisions.gated(ids("Q5"), year(499)), decisions.gated(ids("Q5"), year(500)), decisions.gated(ids("Q5", "Q33506"), year(None)), decisions.gated(ids(None, "Q5"), year(None)), decisions.gated(ids(), year(-3))) == (False, False, True, True, False, False)


def test_fragment_and_severity(spark):
    f = lambda t, p, s: decisions.fragment(F.lit(t), F.lit(p), F.lit(s))
    assert one(spark, f("V век", 0, "V"), f("(ə)", 1, "ə"), f("ab", 0, "a"), f("a - b", 2, "-"), f("xyz", 0, "xy"), f("é", 0, "e"), f("", 0, "")) == (False, True, True, False, False, True, False)
    assert one(spark, decisions.severity(F.lit(None).cast("string")), decisions.severity(F.lit("Terror")), decisions.severity(F.lit("fine"))) == ("minor", "major", "minor")


def test_badge_without_a_known_way(spark):
    b = lambda way, bare, qid, n: decisions.badge(F.lit(way).cast("string"), F.lit(bare), F.lit(qid).cast("string"), F.lit(n))
    assert one(spark, b(None, True, "Q1", 3), b(None, True, None, 3), b(None, False, "Q1", 2), b(None, False, "Q1", 1), b(None, False, "Q1", 0), b(None, False, None, 1), b("new", False, "Q1", 0), b("", False, None, 0)) == ("det", "none", "llm", "det", "none", "rej", "none", "none")


def test_route_choice_relaxes_in_order(spark):
    rows = [("a", 1, False, 5, 0.95, True, None, 1.0), ("a", 2, False, 5, 0.9, True, 9.0, None), ("a", 3, False, 5, 0.5, True, 0.0, 0.0), ("b", 1, False, 1, 0.1, True, 1.0, 2.0), ("b", 2, False, 1, 0.1, True, 1.0, 2.0), ("b", 3, False, 5, 1.0, None, 0.0, 0.0), ("c", 1, False, 1, 1.0, False, 1.0, 1.0), ("d", 1, True, 5, 1.0, True, 1.0, 1.0), ("d", 2, False, 0, 0.0, True, 1.0, 1.0)]
    schema = "g string, route int, dead boolean, n_success int, success_rate double, honest boolean, cost double, latency double"
    got = decisions.choose_route(spark.createDataFrame(rows, schema), "g")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [("a", 2, 0), ("b", 1, 1), ("c", 1, 2), ("d", None, None)]
    assert decisions.choose_route(spark.createDataFrame([], schema), "g").count() == 0


def test_enumerate_all_over_blocks(spark):
    rows = [(d, p) for d in (-5, -1, 0, 3, 4, 9, 10, 1000) for p in range(d % 3 + 1)]
    df = spark.createDataFrame(rows, "d long, p int").orderBy(F.rand(1))
    got = {(r.d, r.p): r.n for r in decisions.enumerate_all(df, "d", "p", "n", width=4).collect()}
    assert got == {x: i for i, x in enumerate(sorted(rows))}
    assert decisions.enumerate_all(df.where("d > 5000"), "d", "p", "n").count() == 0


def test_summary_of_nothing(spark):
    t = spark.createDataFrame([], "g string, o int, tone string")
    assert tuple(decisions.group_summary(t, "g", "o", "tone").first()) == (0, 0, 0, 0, 0)


def test_rounding_and_bands(spark):
    assert one(spark, decisions.half_up(F.lit(7.25)), decisions.half_up(F.lit(-7.25)), decisions.score_band(F.lit(8.0)), decisions.score_band(F.lit(5.99)), decisions.score_band(F.lit(None).cast("double"))) == (7.3, -7.2, "green", "red", None)

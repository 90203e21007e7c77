"""Work that must not grow with the square of a group, against plain computation."""

import random

from pyspark.sql import functions as F

from lexigauge.operators import pairing


def test_first_others(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)])) for _ in range(120)] + [("c", 1), ("c", 1)]
    df = spark.createDataFrame(rows, "k string, id int")
    got = pairing.first_others(df.withColumnRenamed("id", "m"), df, ["k"], "m", "id", 5)
    want = []
    for k, m in rows:
        want += [(m, c) for c in sorted(c for j, c in rows if k is not None and j == k and c is not None and m is not None and c != m)[:5]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_first_others_of_a_large_group(spark):
    df = spark.range(30000).select(F.lit("a").alias("k"), F.col("id").alias("m"))
    got = pairing.first_others(df, df, ["k"], "m", "m", 5)
    assert got.groupBy("m").count().where("count = 5").count() == 30000


def test_spearman_of_one_large_key(spark):
    from lexigauge.operators import stats

    rng = random.Random(5)
    rows = [(rng.choice([None, "k"]), rng.choice([None, 1.0, 2.5, float(i)]), rng.choice([3.0, float(i % 40), None])) for i in range(600)]
    got = {r["k"]: (r["n"], r["rho"]) for r in stats.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    for key in (None, "k"):
        own = [(x, y) for k, x, y in rows if k == key and x is not None and y is not None]
        a, b = ([sorted(v).index(i) + (v.count(i) + 1) / 2 for i in v] for v in ([x for x, _ in own], [y for _, y in own]))
        mean = (len(own) + 1) / 2
        cov = lambda p, q: sum((i - mean) * (j - mean) for i, j in zip(p, q))
        assert got[key] == (len(own), round(cov(a, b) / (cov(a, a) * cov(b, b)) ** 0.5, 4))
    plan = stats.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan  # a window of a key's rows would hold them all in one task


def test_segments_of_one_large_key(spark):
    from lexigauge.operators import shaping

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), rng.choice([None, *range(30)])) for _ in range(200)]
    want = set()
    for k in "ab":
        own = [(s, e) for q, s, e in rows if q == k]
        ends = sorted({x for p in own for x in p if x is not None})
        for a, b in zip(ends, ends[1:]):
            n = sum(s is not None and e is not None and s <= a and b <= e for s, e in own)
            want |= {(k, a, b, n)} if n else set()
    got = shaping.segments(spark.createDataFrame(rows, "k string, s long, e long"), "k")
    assert {tuple(r) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # 1,000 spans of a key would make millions of pairs


def test_only_redirected_titles_hop(spark):
    from lexigauge.operators import shaping

    titles = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "title string")
    red = spark.createDataFrame([("a", "b"), ("b", None), ("z", None), ("z", None)], "src string, dst string")
    got = sorted(map(str, shaping.redirect_chain(titles, red).collect()))
    assert got == sorted(map(str, spark.createDataFrame([("a", "b", 1), ("a", "b", 1), ("z", "z", 0), (None, None, 0)], "title string, target string, n_hops int").collect()))

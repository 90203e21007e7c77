"""Paired tests against plain computation."""

import hashlib
import math
import random

import pytest

from lexigauge.operators import paired


def ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def test_signed_ranks_and_holm(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0, 0, 1, -1, 2, -3, 2.5, rng.uniform(-2, 4)])) for k in "aabbbccc" for _ in range(40)] + [("zero", 0.0), ("none", None)]
    rows = [(k, None if v is None else float(v)) for k, v in rows]
    out = paired.holm(paired.signed_ranks(spark.createDataFrame(rows, "k string, d double"), ["k"], "d"), [], order=["k"])
    got = {r["k"]: r for r in out.collect()}
    assert got.keys() == {"a", "b", "c", "zero"}
    for k in "abc":
        d = [v for n, v in rows if n == k and v]
        r = ranks([abs(v) for v in d])
        up, down = sum(x for x, v in zip(r, d) if v > 0), sum(x for x, v in zip(r, d) if v < 0)
        assert (got[k]["n"], got[k]["n_zero"]) == (len(d), sum(n == k and v == 0 for n, v in rows))
        assert (got[k]["w_plus"], got[k]["w_minus"], got[k]["w"]) == pytest.approx((up, down, min(up, down)))
    assert (got["zero"]["z"], got["zero"]["p"], got["zero"]["n_zero"]) == (None, 1.0, 1)
    ps = sorted((r["p"], k) for k, r in got.items())
    top = 0.0
    for i, (p, k) in enumerate(ps):
        top = max(top, min(1.0, p * (len(ps) - i)))
        assert got[k]["p_holm"] == pytest.approx(top)


def test_normal_tail(spark):
    z = spark.createDataFrame([(0.0,), (1.96,), (-2.5758,), (5.0,)], "z double")
    got = [r[0] for r in z.select(paired.normal_tail(z["z"])).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / 2**0.5) for x in (0.0, 1.96, -2.5758, 5.0)], abs=3e-7)


def test_running_total_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(k, v, rng.randint(1, 9)) for k in range(3) for v in range(300)]
    df = spark.createDataFrame(rows, "k int, v int, n long").repartition(7)
    got = {(r["k"], r["v"]): r["before"] for r in paired.running_total(df, ["k"], "v", "n", "before").collect()}
    assert got == {(k, v): sum(m for j, u, m in rows if j == k and u < v) for k, v, _ in rows}


def test_bootstrap(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), u, rng.gauss(1, 2)) for u in range(60) for _ in range(2)] + [("a", None, 5.0), ("a", 1, None)]
    got = {r["k"]: r for r in paired.bootstrap(spark.createDataFrame(rows, "k string, u int, d double"), ["k"], "u", "d", replicates=40, seed=7).collect()}
    for k in "ab":
        own = [(u, d) for n, u, d in rows if n == k and u is not None and d is not None]
        means = []
        for i in range(10):
            for j in range(4):
                w = {u: sum(int(hashlib.md5(f"7:{u}:{i}".encode()).hexdigest()[8 * j : 8 * j + 8], 16) / 2**32 >= c for c in paired.POISSON) for u, _ in own}
                if total := sum(w[u] for u, _ in own):
                    means.append(sum(w[u] * d for u, d in own) / total)
        means.sort()
        n = len(means)
        assert got[k]["mean"] == pytest.approx(sum(d for _, d in own) / len(own))
        assert (got[k]["low"], got[k]["high"]) == pytest.approx((means[-(-n * 5 // 200) - 1], means[-(-n * 195 // 200) - 1]))
        assert got[k]["low"] < got[k]["mean"] < got[k]["high"]
    with pytest.raises(ValueError):
        paired.bootstrap(spark.createDataFrame(rows, "k string, u int, d double"), ["k"], "u", "d", replicates=6)


def test_numbered_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(6)
    from pyspark.sql import functions as F

    from lexigauge.operators.shaping import ranked

    got = {r["i"]: r["place"] for r in paired.numbered(df, [F.desc("v"), F.col("i")]).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] or -1), r[1]))
    assert got == {i: n for n, (_, i) in enumerate(order)}
    up = {r["i"]: r["place"] for r in ranked(df, "v", ["i"], descending=False).collect()}
    assert up == {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] or 0, r[1])), 1)}
    assert paired.numbered(df.limit(0), [F.col("i")]).count() == 0


def test_ranges_are_dealt_once(spark):
    """Narrow and wide plans used to coalesce ranges in different ways, so that starts belonged to other tasks."""
    from pyspark.sql import functions as F

    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(20000, numPartitions=7).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.lit(1).alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        assert all(r["i"] == r["place"] for r in paired.numbered(df, [F.col("i")]).collect())
        assert all(r["i"] == r["before"] for r in paired.running_total(df, ["k"], "i", "n", "before").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_ranked_unnamed_last(spark):
    from lexigauge.operators.shaping import ranked

    rows = spark.createDataFrame([(None, 1.0), (3, 1.0), (2, None)], "para long, aggregate double")
    assert {r["para"]: r["place"] for r in ranked(rows, "aggregate", ["para"]).collect()} == {3: 1, None: 2, 2: 3}

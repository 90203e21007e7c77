"""Exchange clustering against brute force on a few units."""

import numpy as np

from lexigauge.llm import brown


def table(cls, counts):
    g = np.zeros((brown.CLASSES, brown.CLASSES))
    for (u, v), n in counts.items():
        g[cls[u], cls[v]] += n
    return g


def test_no_single_move_gains(spark):
    rng = np.random.default_rng(5)
    n_units = brown.PARTS  # so the last sweep moves one unit at a time
    counts = {(u, v): int(rng.integers(1, 200)) for u in range(n_units) for v in range(n_units) if rng.random() < 0.7}
    rows = spark.createDataFrame([(u * n_units + v, n) for (u, v), n in counts.items()], "key long, n long").repartition(3)
    cls, g, of_unit = brown.cluster(spark, rows, n_units)
    assert np.array_equal(g, table(cls, counts)) and cls[0] == 0 and (cls[1:] > 0).all()
    assert [int(x) for x in of_unit] == [sum(n for (_, v), n in counts.items() if v == u) for u in range(n_units)]
    best = brown.likelihood(g)
    for u in range(1, n_units):
        for c in range(1, brown.CLASSES):
            other = cls.copy()
            other[u] = c
            assert brown.likelihood(table(other, counts)) <= best + brown.LEAST_GAIN * abs(best) + 1e-6


def test_words_of_a_kind_share_a_class(spark):
    # two kinds that follow each other, each of ten times more words than classes would separate by chance
    n_units = 1 + 2 * brown.CLASSES
    kinds = [range(1, 1 + brown.CLASSES), range(1 + brown.CLASSES, n_units)]
    rows = [(a * n_units + b, 3) for k in (0, 1) for a in kinds[k] for b in kinds[1 - k]]
    start = np.concatenate([[0], 1 + np.arange(n_units - 1) % (brown.CLASSES - 1)])
    cls, g, _ = brown.cluster(spark, spark.createDataFrame(rows, "key long, n long"), n_units)
    counts = {divmod(k, n_units): n for k, n in rows}
    assert brown.likelihood(g) > brown.likelihood(table(start, counts))
    mixed = {c for c in cls[list(kinds[0])]} & {c for c in cls[list(kinds[1])]}
    assert not mixed


def test_rounds_on_the_driver_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n_units = 150
    rows = [(int(u) * n_units + int(v), int(rng.integers(1, 90))) for u, v in rng.integers(0, n_units, (4000, 2))]
    df = spark.createDataFrame(rows, "key long, n long").groupBy("key").sum("n").toDF("key", "n")
    here = brown.cluster(spark, df, n_units)
    monkeypatch.setattr(brown, "HELD", 0)
    there = brown.cluster(spark, df, n_units)
    assert all(np.array_equal(a, b) for a, b in zip(here, there))

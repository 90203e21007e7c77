"""What scoring puts between its steps: a row for each slice, block or batch, not for each word."""

import random

import numpy as np
import pyarrow as pa

from lexigauge.llm import brown


def texts_of(n_texts):
    rng = random.Random(6)
    return [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(30)), i % 5 == 1) for i in range(n_texts)]


def test_texts_ask_for_words_by_slice(spark):
    rows = texts_of(200)
    total = sum(31 for _ in rows)
    w = brown.Words([(" ", 200), ("w1", 400)], total)
    w.blocks = 3
    model = (np.zeros(w.n_units, np.int64), np.zeros((brown.CLASSES, brown.CLASSES)), np.zeros(brown.CLASSES), np.zeros(2), np.zeros(2))
    run = brown._scored(spark.sparkContext.broadcast(w), spark.sparkContext.broadcast(model))
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)
    got = df.mapInArrow(run, getattr(brown, "CODED", None) or brown.SCORED).collect()
    assert len(got) == 1  # was one for each text and word of it
    asked = [x for a in got[0]["asked"] for x in bytes(a["words"]).split(b"\n")]
    assert sorted(asked) == sorted({x.encode() for _, t, _ in rows for x in t.split()} - {b"w1"})


def test_counts_and_unit_bigrams_leave_a_batch_by_block(spark):
    df = spark.createDataFrame(texts_of(200), "doc_id long, text string, held_out boolean").select("text").coalesce(1)
    packed = df.mapInArrow(brown._count(4), brown.COUNTED)
    assert packed.count() == 4
    got = {r["word"]: r["n"] for r in packed.groupBy("block").applyInArrow(brown._count_all, "word string, n long").collect()}
    flat = [x.decode() for _, t, _ in texts_of(200) for x in brown.tokens(t.encode())]
    assert got == {x: flat.count(x) for x in set(flat)}


def test_endings_of_an_array():
    words = ["a", "ab", "abc", "abcd", "é", "日本", "", "x" * 99]
    assert brown.endings(pa.array(words)).tolist() == [brown.ending(x.encode()) for x in words]
    assert brown.endings(pa.array(words)[3:]).tolist() == [brown.ending(x.encode()) for x in words[3:]]


def plainly_moved(cls, at, code, n, g, steps):
    """brown.moved() word by word, all sums anew."""
    cls, g, size = cls.copy(), g.copy(), brown.CLASSES
    edges = np.unique(np.linspace(0, len(cls), steps + 1).astype(np.int64))
    for i, j in zip(edges[:-1], edges[1:]):
        seen = g.copy()
        for u in range(i, j):
            right, left = np.zeros(size), np.zeros(size)
            for k, m in zip(code[at == u], n[at == u]):
                (right if k < size else left)[k % size] += m
            a, row, col = cls[u], seen.sum(1), seen.sum(0)
            rise = lambda x, y: brown._xlogx(np.maximum(x + y, 0)) - brown._xlogx(x)
            gain = rise(seen, right).sum(1) + rise(seen.T, left).sum(1) - rise(row, right.sum()) - rise(col, left.sum())
            gain[a] = -(rise(seen[a], -right).sum() + rise(seen[:, a], -left).sum() - rise(row[a], -right.sum()) - rise(col[a], -left.sum()))
            stay, gain[0] = gain[a], -np.inf
            b = int(np.argmax(gain))
            if b != a and gain[b] > stay + 1e-9:
                cls[u] = b
                g[a] -= right
                g[:, a] -= left
                g[b] += right
                g[:, b] += left
        np.maximum(g, 0, out=g)
    return cls


def test_words_move_as_one_by_one():
    rng, size = np.random.default_rng(9), brown.CLASSES
    cls = rng.integers(1, size, 300)
    at = np.repeat(np.arange(300), 12)
    key = np.unique(at * 2 * size + rng.integers(0, 2 * size, len(at)))
    n = np.minimum(rng.zipf(1.5, len(key)), 200)  # once, a few times, and beyond what is looked up
    at, code = key // (2 * size), key % (2 * size)
    g = rng.integers(0, 900, (size, size)).astype(float) * (rng.random((size, size)) < 0.7)
    got = brown.moved(cls, at, code, n, g, np.ones(300, bool), 1.0, 5)
    assert (n == 1).sum() > 500 and (n > 64).sum() > 20 and (got != cls).sum() > 30
    assert np.array_equal(got, plainly_moved(cls, at, code, n, g, 5))

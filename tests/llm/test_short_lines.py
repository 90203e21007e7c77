"""Line dedup of lines of one to six words: exact repeats go, four words meet five."""

import random

from lexigauge.llm import linededup


def slow(rows):
    """doc_id to (n_links, n_exact, removed) by comparing all sets of at least a word."""
    lines = [(doc, k, frozenset(line.lower().split())) for doc, text in sorted(rows) for k, line in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[2]]
    first = {}
    for doc, k, s in lines:
        first.setdefault(s, (doc, k))
    order = list(first)
    near = {x: [y for y in order if y != x and 5 * len(x & y) >= 4 * len(x | y)] for x in order}
    late = {x for i, x in enumerate(order) if any(y in near[x] for y in order[:i])}
    out = {}
    for doc, _ in rows:
        mine = [(k, s) for d, k, s in lines if d == doc]
        exact = [k for k, s in mine if first[s] != (doc, k)]
        out[doc] = (sum(len(near[s]) for s in {s for _, s in mine}), len(exact), ",".join(str(k) for k, s in mine if k in exact or s in late))
    return out


def got(spark, rows):
    return {r["doc_id"]: (r["n_links"], r["n_exact"], r["removed"]) for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_short_repeats_go(spark):
    rows = [(1, "Share\nRead more\n\na b c d"), (2, "share\nmore read\n\na b c d e"), (3, "Share\nmore\n  \na b c")]
    assert got(spark, rows) == {1: (1, 0, ""), 2: (1, 2, "0,1,3"), 3: (0, 1, "0")}


def test_short_lines_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(9)]
    rows = [(i, "\n".join(" ".join(rng.choices(vocab, k=rng.randint(0, 6))) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    want = slow(rows)
    assert got(spark, rows) == want
    assert sum(x[0] for x in want.values()) and sum(x[1] for x in want.values())

"""Decontamination against every run of every diagonal that a seed meets, with words substituted anywhere."""

import random

import numpy as np

from lexigauge.llm import decontam


def slow_best(same):
    """(words, equal words) of the longest run of 13 words or more of which four fifths are equal."""
    n = len(same)
    runs = [(e - s, sum(same[s:e])) for s in range(n) for e in range(s + 13, n + 1) if 5 * sum(same[s:e]) >= 4 * (e - s)]
    return max(runs, default=None)


def seeded(x, y, diagonal):
    for at in range(len(y)):
        for mask in decontam.MASKS:
            on = [k for k, c in enumerate(mask) if c == "1"]
            if at + len(mask) <= len(y) and 0 <= at + diagonal <= len(x) - len(mask) and all(x[at + diagonal + k] == y[at + k] for k in on):
                return True
    return False


def test_clumped_substitutions():
    same = [1] * 12 + [0] * 2 + [1] * 4
    item = np.arange(18)
    doc = np.where(same, item, -1)
    assert decontam.verify(doc, item, 0, 13, 0.8) == (18, 16, 0, 0)
    assert decontam.verify(np.where([1] * 5 + [0] * 8 + [1] * 5, item, -1), item, 0, 13, 0.8) is None


def test_longest_run_equals_brute_force():
    rng = random.Random(11)
    found = 0
    for _ in range(600):
        n = rng.randint(17, 45)
        rate = rng.choice((0.05, 0.1, 0.2, 0.3))
        same = [int(rng.random() >= rate) for _ in range(n)]
        got = decontam.verify(np.where(same, np.arange(n), -1), np.arange(n), 0, 13, 0.8)
        assert (got and got[:2]) == slow_best(same)
        found += got is not None
    assert 300 < found < 600


def test_random_substitutions_equal_brute_force_in_both_forms(spark):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, rng.choices(vocab, k=rng.randint(17, 45))) for i in range(60)]
    docs = []
    for i, w in items:
        rate = rng.choice((0.05, 0.1, 0.2))
        docs.append((i, rng.choices(vocab, k=20) + [x if rng.random() >= rate else f"z{rng.random()}"[:9].replace(".", "") for x in w] + rng.choices(vocab, k=20)))
    want = {}
    for d, x in docs:
        for i, y in items:
            runs = [best for g in range(-len(y), len(x)) if seeded(x, y, g) and (best := slow_best([int(0 <= k + g < len(x) and x[k + g] == y[k]) for k in range(len(y))]))]
            if runs:
                want[d, i] = max(runs, key=lambda r: r[::-1])
    assert len(want) > 45
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for form in ({}, {"broadcast_words": 0}):
        assert {(r[0], r[1]): (r[2], r[3]) for r in decontam.overlaps(d, b, **form).collect()} == want

"""Near-duplicate classes against all pairs, in one share and in many, and rows repeated under a doc_id."""

import random
from collections import Counter

import numpy as np
import pytest

from lexigauge.llm import neardup


def all_pairs(rows):
    """doc_id to class by comparing every two texts' shingles exactly."""
    def weights(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    sets = [weights(t) for _, t in rows]
    number = {k: i for i, k in enumerate(dict.fromkeys(k for s in sets for k in s))}
    packed = [(np.array(sorted(number[k] for k in s)), np.array([w for _, w in sorted((number[k], w) for k, w in s.items())], float)) for s in sets]
    up = list(range(len(rows)))
    top = lambda i: i if up[i] == i else top(up[i])
    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if neardup.similarity(*packed[i], *packed[j]) >= 0.8:
                links += 1
                up[top(i)] = top(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}, links


@pytest.mark.parametrize("side", [512, 4])
def test_classes_equal_all_pairs(spark, monkeypatch, side):
    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(900)], []
    for g in range(14):
        base = rng.choices(words, k=120)
        for k in range(10):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows) * 7 % 1000, " ".join(w)))
    monkeypatch.setattr(neardup, "SIDE", side)
    want, links = all_pairs(rows)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and links > 100


def test_rows_repeated_under_a_doc_id(spark):
    a, b = "one text of six words here", "another thing altogether with other words"
    rows = [(1, a), (5, a), (5, b), (6, b), (6, b), (None, a), (7, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "x", t) for i, t in rows], "doc_id long, text string, `a.b` string, same string")
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["a.b"], r["same"] or "") for r in neardup.dedup(docs).collect())
    assert got == [(0, a, "x", a), (1, a, "x", a), (5, b, "x", b), (7, "", "x", ""), (7, "", "x", ""), (7, "", "x", "")]
    classes = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["copy_of"] or 0) for r in neardup.classes(docs).collect())
    assert classes == [(0, 0, 0), (1, 1, 1), (5, 1, 1), (5, 5, 5), (6, 5, 5), (6, 5, 5), (7, 7, 7), (7, 7, 7), (7, 7, 7)]


def test_one_text_meets_many_at_a_time():
    rng = random.Random(3)
    sets = []
    for k in range(60):
        h = np.array(sorted(rng.sample(range(40), rng.randint(1, 40))), "<u4")
        w = np.array([1 if k % 2 else rng.randint(1, 5) for _ in h], "<u4")
        sets.append(b"" + h.tobytes() if (w == 1).all() else b"w" + w.tobytes() + h.tobytes())
    group = neardup.Group(sets)
    for i in range(60):
        others = [j for j in range(60) if j != i]
        for j, most, exact in zip(others, *group.bounds(i, others)):
            got = neardup.similarity(*neardup._unpack(sets[i]), *neardup._unpack(sets[j]))
            assert most == got if exact else most >= got


def test_many_texts_just_under_the_threshold_are_not_verified_one_by_one(monkeypatch):
    base = np.arange(1000, dtype="<u4")
    rows = []
    for k in range(120):  # every two share 850 of 1,150 elements: 0.74
        h = np.sort(np.concatenate([base[:850], np.arange(2000 + 150 * k, 2150 + 150 * k, dtype="<u4")]).astype("<u4"))
        rows.append((k, k, np.zeros(neardup.REGISTERS, "<u4").tobytes(), h.tobytes()))
    calls = []
    monkeypatch.setattr(neardup, "similarity", lambda *x: calls.append(1) or 0.0)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1] * 120), *(pa.array([r[k] for r in rows]) for k in range(4))], ["key", "lid", "root", "sig", "set"])
    assert sum(b.num_rows for b in neardup._joined(0.8)(iter([batch]))) == 0 and not calls

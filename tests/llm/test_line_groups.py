"""Line dedup where lists and groups are dealt in shares, and rows repeated under a doc_id."""

import random

from lexigauge.llm import linededup
from tests.llm.test_llm import slow_line_dedup

DOC = "doc_id long, text string"


def test_shares_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(25)], []
    for k in range(90):
        w = list(base)
        w[rng.randrange(25)] = f"x{rng.randrange(30)}"
        rows.append((k, " ".join(w) + "\nshared passage line number " + str(k % 7)))
    docs = spark.createDataFrame(rows, DOC)
    want = slow_line_dedup(rows)
    for name, value in (("LIST", 8), ("SIDE", 8), ("PAIRS", 50)):
        monkeypatch.setattr(linededup, name, value)
    got = linededup.report(docs.repartition(3)).collect()
    assert {r["doc_id"]: (r["n_links"], r["removed"]) for r in got} == want
    assert sum(n for n, _ in want.values()) > 1000


def test_rows_repeated_under_a_doc_id(spark):
    rows = [(1, "alpha beta\ngamma"), (5, "alpha beta\ngamma"), (5, "delta epsilon"), (7, "only here"), (7, "only here"), (None, "alpha beta"), (8, None), (9, " \n")]
    docs = spark.createDataFrame([(i, t, t, "x", 3) for i, t in rows], "doc_id long, text string, _kept string, `a.b` string, n_chars long")
    out = linededup.dedup(docs)
    assert out.columns == docs.columns
    got = sorted(out.collect(), key=lambda r: (r["doc_id"] or 0, r["text"] or ""))
    assert [(r["doc_id"], r["text"], r["_kept"], r["a.b"], r["n_chars"]) for r in got] == [
        (None, "alpha beta", "alpha beta", "x", 3), (1, "alpha beta\ngamma", "alpha beta\ngamma", "x", 3), (5, "delta epsilon", "delta epsilon", "x", 3),
        (7, "only here", "only here", "x", 3), (8, None, None, "x", 3), (9, " \n", " \n", "x", 3),
    ]
    rep = {(r["doc_id"], r["n_lines"], r["removed"], r["class_id"]) for r in linededup.report(docs).collect()}
    assert rep == {(1, 2, "", 1), (5, 2, "0,1", 1), (5, 1, "", 5), (7, 1, "", 7), (None, 1, "", None), (8, 0, "", 8), (9, 2, "", 9)}


def test_overlaps_in_runs_of_words(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    lines = [rng.choice(60, rng.integers(1, 50), replace=False).astype(np.uint64) for _ in range(40)]
    lines += [np.append(w, np.uint64(99)) for w in lines[:10]]
    jaccard = lambda a, b: len({*a.tolist()} & {*b.tolist()}) / len({*a.tolist()} | {*b.tolist()})
    want = np.array([[jaccard(a, b) >= 0.8 for b in lines] for a in lines])
    assert want.sum() > len(lines)
    for cells in (1 << 23, 1):
        monkeypatch.setattr(linededup, "GRID", cells)
        assert (linededup._similar(lines, None, 0.8) == want).all()
        assert (linededup._similar(lines[:7], lines[7:], 0.8) == want[:7, 7:]).all()


def test_long_lines_in_bounded_memory():
    import tracemalloc

    import numpy as np

    base = np.arange(200_000, dtype=np.uint64)
    lines = [np.where(base == k, np.uint64(10**9 + k), base) for k in range(10)]  # as many as a side of SIDE_BYTES holds
    assert sum(x.nbytes for x in lines) <= linededup.SIDE_BYTES
    tracemalloc.start()
    ok = linededup._similar(lines, [x + np.uint64(0) for x in lines], 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ok.all() and peak < 600 << 20

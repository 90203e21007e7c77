"""Funnels against a walk over each client's rows, over many hours and within one, and the edges of the rules."""

import datetime as dt
import random

import pytest

from lexigauge.llm import funnel

START = dt.datetime(2024, 1, 1)


def slow(rows, funnels=funnel.FUNNELS):
    """rows: (client, kind, microseconds since START or None)."""
    rows = {r for r in rows if None not in r}
    out = {}
    for f in funnels:
        for c in {r[0] for r in rows}:
            own = sorted((t, k) for d, k, t in rows if d == c)
            reached, took = [0] * 4, [[] for _ in range(4)]
            for t1, k in own:
                if k != f.steps[0]:
                    continue
                reached[0] += 1
                last = t1
                for i, step in enumerate(f.steps[1:], 1):
                    nxt = min((t for t, k in own if k == step and t > last), default=None)
                    if nxt is None or nxt - t1 > 300_000_000 or any(k == f.excluding and last < t <= nxt for t, k in own):
                        break
                    reached[i] += 1
                    took[i].append(nxt - last)
                    last = nxt
            if reached[0]:
                t = [sorted(x)[-(-25 * len(x) // 100) - 1] if x else None for x in took[1:]]
                out[f.name, c] = (*reached, max(i + 1 for i in range(4) if reached[i]), *t)
    deep = [(k[0], v[4]) for k, v in out.items()]
    return {k: (*v, deep.count((k[0], v[4]))) for k, v in out.items()}


def run(spark, rows, **how):
    data = [(c, k, None if t is None else START + dt.timedelta(microseconds=t), "x") for c, k, t in rows]
    df = spark.createDataFrame(data, "client_id long, kind string, arrived_at timestamp_ntz, share string")
    return {(r[0], r[1]): tuple(r)[2:] for r in funnel.count(df, **how).collect()}


@pytest.mark.parametrize("seed,span,n", [(1, 900, 400), (2, 3 * 3600, 900), (3, 40, 300)])
def test_random_rows(spark, seed, span, n):
    rng = random.Random(seed)
    kinds = ["view", "click", "purchase", "signup", "error", "other", None]
    at = lambda: rng.choice([rng.randrange(span) * 1_000_000, rng.randrange(span * 1_000_000), None if rng.random() < 0.1 else 0])
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choices(kinds, [5, 5, 4, 2, 1, 1, 1])[0], at()) for _ in range(n)]
    want = slow(rows + rows[:50])
    assert any(v[3] for v in want.values())
    assert run(spark, rows + rows[:50]) == want
    assert run(spark, rows, hour=5 * funnel.MINUTE) == want


def test_limits(spark):
    s = 1_000_000
    five = 300 * s
    rows = [(1, "view", 0), (1, "click", 10), (1, "view", five), (2, "view", 0), (2, "click", five + 1), (3, "view", 0), (3, "click", 5), (3, "error", 5), (4, "view", 7), (4, "error", 7), (4, "click", 8)]
    rows += [(5, "view", 3599 * s), (5, "click", 3600 * s), (5, "view", 3601 * s), (5, "purchase", 3899 * s)]
    got = run(spark, rows)
    assert got == slow(rows)
    assert [got["A", c][4] for c in range(1, 6)] == [3, 1, 1, 2, 4]
    assert got["A", 5][:4] == (2, 1, 1, 1)


def test_many_ties_and_a_large_client(spark, monkeypatch):
    monkeypatch.setattr(funnel, "TASK_ROWS", 50)
    rows = [(7, k, t * 600_000_000 + d) for t in range(400) for k, d in (("view", 0), ("click", 1000), ("view", 1000 + t % 3), ("purchase", 90_000_000 + t * 999))]
    assert run(spark, rows) == slow(rows)


def test_empty_and_broken(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, "view", 1), (1, None, 1), (1, "view", None)]) == {}
    with pytest.raises(ValueError):
        run(spark, [], hour=funnel.MINUTE)
    with pytest.raises(ValueError):
        run(spark, [], funnels=(funnel.Funnel("x", ("view",)),))

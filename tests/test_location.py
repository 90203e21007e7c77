"""Substring joins against searching everything, with and without broadcasts, and the rules of location."""

import random

import pytest

from lexigauge.operators import location


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_holding(spark, monkeypatch, broadcast):
    monkeypatch.setattr(location, "BROADCAST_GRAMS", broadcast)
    rng = random.Random(broadcast)
    word = lambda n: "".join(rng.choice("abcé\U0001f600\n") for _ in range(n))
    texts = [(i, word(rng.randint(0, 60))) for i in range(80)] + [(98, None), (99, "")]
    needles = [word(rng.choice([1, 2, 3, 4, 5, 12, 20])) for _ in range(80)] + [texts[3][1][:15], texts[3][1][:15], None, "zz"]
    got = location.holding(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "key int, text string"))
    want = {(n, k) for n in needles for k, t in texts if n is not None and t is not None and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_empty_needle_and_tables(spark):
    texts = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "key int, text string")
    one = lambda *n: spark.createDataFrame([(x,) for x in n], "needle string")
    assert {tuple(r) for r in location.holding(one("", "a"), texts).collect()} == {("", 1), ("", 2), ("a", 1)}
    assert location.holding(one(), texts).count() == 0
    assert location.holding(one("a"), texts.limit(0)).count() == 0


def slow(row, paras):
    if row[1] in [p[0] for p in paras]:
        return row[1], "own"
    context = (row[2] or "").strip()
    for pid, _, text in sorted(paras, key=lambda p: p[1]):
        if context and context[:60] in text:
            return pid, "context"
    if row[3] is not None:
        for pid, _, text in sorted(paras, key=lambda p: p[1]):
            if row[3] in text or row[3][: max(4, len(row[3]) - 2)] in text:
                return pid, "surface"
    return None, None


def test_located(spark):
    rng = random.Random(8)
    paras = [(i, 100 - i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ur"]) for _ in range(30))) for i in range(40)]
    rows = []
    for i in range(200):
        text = rng.choice(paras)[2]
        at = rng.randrange(60)
        context = rng.choice([None, "", "  ", f" {text[at : at + rng.randint(5, 90)]}\n", "nowhere at all"])
        rows.append((i, rng.choice([None, 3, 77, 500]), context, rng.choice([None, "", "ur", "alphaXY", "alphaX", "zeta", text[at : at + 9]])))
    got = location.located(spark.createDataFrame(rows, "id int, paragraph_id int, context string, surface string"), spark.createDataFrame(paras, "paragraph_id int, place int, source string"))
    assert {r["id"]: (r["located"], r["rule"]) for r in got.collect()} == {r[0]: slow(r, paras) for r in rows}
    assert {r["rule"] for r in got.select("rule").distinct().collect()} == {"own", "context", "surface", None}


def test_either_way_and_relabelled(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = location.either_way(names("Ur", "Akkad", "x", "", None), names("city of UR", "akk", "akk", None, "y"))
    assert {tuple(r) for r in got.collect()} == {("Ur", "city of UR"), ("Akkad", "akk")}
    m = spark.createDataFrame([(1, "a", None, "first"), (2, "a", "b", "second"), (3, "c", "", "third")], "place int, surface string, lemma string, context string")
    lemmas = spark.createDataFrame([("a", "z"), ("a", "b"), ("c", "")], "surface string, lemma string")
    assert sorted(map(tuple, location.relabelled(m, lemmas).collect())) == [(1, "a", "b", "first", True), (2, "a", "b", "first", False), (3, "c", "", "third", False)]


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_first_holding(spark, monkeypatch, piece):
    """One row a needle, where pairs with every text grew with the square of the texts."""
    monkeypatch.setattr(location, "PIECE", piece)
    rng = random.Random(piece)
    word = lambda n: "".join(rng.choice("abcé\U0001f600\n") for _ in range(n))
    texts = [(rng.choice([None, *range(9)]), i, word(rng.randint(0, 60))) for i in range(80)] + [(0, 98, None), (4, 99, "")]
    needles = [word(rng.choice([1, 2, 3, 4, 5, 12, 20])) for _ in range(80)] + [texts[3][2][:15], texts[3][2][:15], None, "zz", ""]
    df = spark.createDataFrame(texts, "place int, key int, text string").selectExpr("struct(place, key) AS first", "text")
    got = {r["needle"]: tuple(r["first"]) for r in location.first_holding(spark.createDataFrame([(n,) for n in needles], "needle string"), df).collect()}
    least = lambda x: tuple((v is not None, v) for v in x)
    want = {n: min(((p, k) for p, k, t in texts if t is not None and n in t), key=least) for n in needles if n is not None and any(t is not None and n in t for _, _, t in texts)}
    assert got == want

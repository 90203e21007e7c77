"""Conversation repair against all edits of short conversations, in whole shares and in many, and the rules of damage."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lexigauge.llm import repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        found = BLANK.findall(text)
        out.append("blank" if not found else "again" if (role, text) in seen else "cut" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) of all edits with up to two inserts in a gap, by trying them all."""
    kinds, best = faults(rows), None
    runs = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    each = []
    for (role, text), kind in zip(rows, kinds):
        ways = [("D", 2, ())]
        if kind not in ("blank", "again"):
            more = 5 if kind == "cut" else 0
            ways += [("K", more, ((role, text),)), ("R", more + 1, (("user", text),)), ("R", more + 1, (("assistant", text),))]
        each.append([("I" * len(r) + w[0], 5 * len(r) + w[1], tuple((x, "") for x in r) + w[2]) for r in runs for w in ways])
    each.append([("I" * len(r), 5 * len(r), tuple((x, "") for x in r)) for r in runs])
    for way in itertools.product(*each):
        out = [t for w in way for t in w[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            found = (sum(w[1] for w in way), "".join(w[0] for w in way), "\n".join(f"{r}:{t}" for r, t in out))
            best = min(best, found) if best else found
    return best


def by_strings(rows):
    """Cost and audit by a programme that holds strings."""
    layer = {repair.EMPTY: (0, "")}
    for (role, _), kind in zip(rows, faults(rows)):
        symbol = "D" if kind in ("blank", "again") else (role[:1] if role[:1] in ("s", "u", "a") else "x") + ("!" if kind == "cut" else "")
        nxt = {}
        for state, (cost, audit) in layer.items():
            for code, more, to in repair.macros(state, symbol):
                nxt[to] = min(nxt.get(to, (cost + more, audit + code)), (cost + more, audit + code))
        layer = nxt
    return min((c + 5 * repair.TAILS[s], a + "I" * repair.TAILS[s]) for s, (c, a) in layer.items())


def row(rng):
    return rng.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", "c!", "\t", "d?\n", "e. f", "x.", "y.", "z."])


def frame(spark, convs, gone=()):
    data = [(c, t, r, x, c in gone, 1) for c, rows in convs.items() for t, (r, x) in enumerate(rows)]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, gone boolean, share int")


def test_all_edits_of_short_conversations(spark):
    rng = random.Random(3)
    convs = {c: [row(rng) for _ in range(rng.randint(0, 3))] for c in range(150)}
    got = {r["conv_id"]: r for r in repair.repair(frame(spark, convs)).collect()}
    assert got.keys() == {c for c, r in convs.items() if r}
    for c, r in got.items():
        cost, audit, text = cheapest(convs[c])
        kinds = faults(convs[c])
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), convs[c]
        assert (r["blank"], r["duplicate"], r["truncated"], r["gaps"]) == (kinds.count("blank"), kinds.count("again"), kinds.count("cut"), 0)
        initials = [x[:1] for x, _ in convs[c]]
        assert r["illegal"] == sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))


def test_layers_against_strings():
    rng = random.Random(5)
    layers = repair.Layers()
    for n in [*range(1, 30), 400]:
        for _ in range(20):
            rows = [(r, f"{x} {i}" if x.strip() and rng.random() < 0.8 else x) for i, (r, x) in enumerate(row(rng) for _ in range(n))]
            kinds = faults(rows)
            word = ["D" if k in ("blank", "again") else (r[:1] if r[:1] in ("s", "u", "a") else "x") + ("!" if k == "cut" else "") for (r, _), k in zip(rows, kinds)]
            path, spent = layers.forward(repair.EMPTY, word)
            cost, end = repair.finish(layers.layers[path[-1]])
            audit = "".join(c for c, _ in layers.rebuilt(path, word, end)) + "I" * repair.TAILS[end]
            assert (cost + spent, audit) == by_strings(rows)
    assert len(layers.layers) < 1000


@pytest.mark.parametrize("share", [7, 3])
def test_long_conversations_over_many_shares(spark, monkeypatch, share):
    rng = random.Random(share)
    convs = {c: [row(rng) for _ in range(n)] for c, n in enumerate([1, 60, 2, 3, 90, 1, 5])}
    df = frame(spark, convs)
    df = df.unionByName(spark.createDataFrame([(None, None, "user", "x.", False, 1), (None, 4, "assistant", "y.", False, 1), (9, 1, "user", "", True, 1)], df.schema))
    whole = sorted(map(tuple, repair.repair(df).collect()), key=str)
    monkeypatch.setattr(repair, "SHARE_ROWS", share)
    monkeypatch.setattr(repair, "PART", 10)
    assert sorted(map(tuple, repair.repair(df.repartition(3)).collect()), key=str) == whole
    by = {r[0]: r for r in whole}
    for c, rows in convs.items():
        assert (by[c][6], by[c][7]) == by_strings(rows)
    assert by[9] == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert by[None][1:8] == (0, 0, 0, 0, 0, 0, "KK")


def test_damage(spark):
    data = [(c, t, r, x) for c in range(60) for t, (r, x) in enumerate([("user", "Hi. Is it?"), ("assistant", None), (None, "No!")])] + [(None, None, "user", "x."), (70, None, "user", "x.")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in data:
        r, x = " " if r is None else r, " " if x is None else x
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if hit in (0, 1) else re.sub("[.!?]", "", x) if hit == 2 else x
        want += [(c, t, "user" if hit == 4 else r, x, hit == 0)] * (2 if hit == 3 else 1)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=str) == sorted(want, key=str)
    got = {r["conv_id"]: r for r in repair.repair(repair.damaged(df)).collect()}
    assert len(got) == 62
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0


def test_gaps_and_ties(spark):
    data = [(1, t, "user", x, False) for t, x in ((4, "a."), (9, "b."), (4, "c."), (None, "d."), (6, "e."))] + [(2, None, "user", "a.", False)]
    got = {r[0]: r for r in repair.repair(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, gone boolean")).collect()}
    assert (got[1][1], got[2][1]) == (3, 0)

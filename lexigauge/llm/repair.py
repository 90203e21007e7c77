"""Repair of conversations: the cheapest edits that make turns alternate, by a dynamic programme over macro edits.

A layer of the programme stands between two rows. A macro edit is a run of inserted turns and what becomes of the next row
("K", "IR", "IID"), so its code ends with its only letter that isn't I: no code is a prefix of another, nor is a sequence
of them a prefix of another of as many. Two edits of the same rows thus compare as the ranks of their first parts and then
their last codes, and a layer holds a cost and a rank for each of four states instead of strings; parent pointers rebuild
the edits afterward. Costs over the least and ranks take few values, so steps between layers are looked up.

Rows are dealt out by range of (conversation, turn), whatever a conversation's length. Where one goes over several
shares, each share gives the cost and rank of every way from state to state, these are chained, and each share then
rebuilds its own part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, ship

BLANKS = " \t\n\x0b\x0c\r"
#: Edits' costs; a row cut short costs CUT more unless it is deleted.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States after a row's edit: nothing yet, a system turn, user (an answer is due), assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Whatever a dearer state can still do, a cheaper one can do for less: at most two inserts and a deletion more.
SLACK = 2 * INSERT + DELETE
#: Rows of a share, the most shares, and bytes in a row of a text that goes to the hash in parts.
SHARE_ROWS, SHARE_BYTES, MOST_SHARES, PART = 20_000, 16 << 20, 100_000, 4096


def inserted(state: int, runs: int) -> int:
    """The state after so many inserted turns."""
    for _ in range(runs):
        state = ASSISTANT if state == USER else USER
    return state


def macros(state: int, row: str):
    """(code, cost, next state) of a row. row: "D" for one that must go, else its role's initial and "!" if it is cut short.

    More than two inserts in a run come back to a state that fewer reach.
    """
    for runs in range(3):
        at, spent, code = inserted(state, runs), runs * INSERT, "I" * runs
        yield code + "D", spent + DELETE, at
        if row == "D":
            continue
        more = CUT if row.endswith("!") else 0
        if (at, row[:1]) in AFTER:
            yield code + "K", spent + more, AFTER[at, row[:1]]
        for initial in "ua":
            if (at, initial) in AFTER:
                yield code + "R", spent + more + REROLE, AFTER[at, initial]


class Layers:
    """Layers met so far and the steps between them. A layer: for each state its cost over the least and its rank, or None."""

    def __init__(self):
        self.layers, self.number, self.steps, self.back = [], {}, {}, {}
        self.first = [self._id(tuple((0, 0) if s == k else None for s in range(4))) for k in range(4)]

    def _id(self, layer) -> int:
        if layer not in self.number:
            self.number[layer] = len(self.layers)
            self.layers.append(layer)
        return self.number[layer]

    def step(self, layer: int, row: str) -> tuple[int, int]:
        """(next layer, cost that it leaves out)."""
        if (layer, row) not in self.steps:
            best = {}
            for state, held in enumerate(self.layers[layer]):
                if held:
                    for code, cost, to in macros(state, row):
                        way = (held[0] + cost, held[1], code, state)
                        best[to] = min(best.get(to, way), way)
            low = min(w[0] for w in best.values())
            best = {to: w for to, w in best.items() if w[0] - low <= SLACK}
            ranks = {w[1:3]: i for i, w in enumerate(sorted(best.values(), key=lambda w: w[1:3]))}
            nxt = tuple((best[s][0] - low, ranks[best[s][1:3]]) if s in best else None for s in range(4))
            self.steps[layer, row] = self._id(nxt), low
            self.back[layer, row] = {to: (w[3], w[2]) for to, w in best.items()}
        return self.steps[layer, row]

    def forward(self, start: int, rows) -> tuple[list[int], int]:
        """The layers between rows from one state on, and the cost that the last one leaves out."""
        path, spent = [self.first[start]], 0
        for row in rows:
            layer, cost = self.step(path[-1], row)
            path.append(layer)
            spent += cost
        return path, spent

    def rebuilt(self, path: list[int], rows, end: int) -> list[tuple[str, int]]:
        """(code, state after it) of every row, on the way that ends in a state."""
        out = []
        for layer, row in zip(path[-2::-1], rows[::-1]):
            before, code = self.back[layer, row][end]
            out.append((code, end))
            end = before
        return out[::-1]


#: Inserts that may follow the last row, by the state they start from.
TAILS = {EMPTY: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}


def finish(layer) -> tuple[int, int]:
    """(cost, last state) of the best whole conversation: least cost, then least rank."""
    cost, _, state = min((held[0] + TAILS[s] * INSERT, held[1], s) for s, held in enumerate(layer) if held)
    return cost, state


def chained(shares: list[list]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of a conversation that goes over several shares, and (first state, last state) in each.

    shares: for each first state the layer (cost and rank of each last state) of the share.
    """
    layer, back = tuple((0, 0) if s == EMPTY else None for s in range(4)), []
    for share in shares:
        best = {}
        for state, held in enumerate(layer):
            if held:
                for to, way in enumerate(share[state]):
                    if way:
                        found = (held[0] + way[0], held[1], way[1], state)
                        best[to] = min(best.get(to, found), found)
        ranks = {w[1:3]: i for i, w in enumerate(sorted(best.values(), key=lambda w: w[1:3]))}
        layer = tuple((best[s][0], ranks[best[s][1:3]]) if s in best else None for s in range(4))
        back.append({to: w[3] for to, w in best.items()})
    cost, state = finish(layer)
    ends = []
    for before in reversed(back):
        ends.append((before[state], state))
        state = before[state]
    return cost, ends[::-1]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows after damage by their crc32; rows that it drops stay, marked."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("hit"))
    text = F.when(F.col("hit").isin(0, 1), "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"), F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_"))
    return out.drop("_")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows in the order of conversation and turn, with their share and a position that grows along the order."""
    told = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    shares = min(MOST_SHARES, max(1, -(-told["n"] // SHARE_ROWS), -(-(told["b"] or 0) // SHARE_BYTES)))
    stem = F.rtrim("text", F.lit(BLANKS))
    kind = F.when(F.col("gone"), "gone").when(stem == "", "blank").when(~F.right(stem, F.lit(1)).isin(".", "!", "?"), "cut").otherwise("")
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.select("conv_id", "turn", "role", "text", kind.alias("kind"), mark.alias("mark"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "mark", "row"]
    rows = rows.repartitionByRange(shares, *order).sortWithinPartitions(*order)
    return keep(rows.drop("row").withColumn("share", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()))


def _slices(conv: list) -> list[tuple[int, int]]:
    """(first, past the last) row of each conversation in a share's rows."""
    cuts = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]] + [len(conv)]
    return list(zip(cuts, cuts[1:]))


def _held(rows, firsts):
    """A share in order as columns, with the row's symbol for the programme: "" for rows that damage dropped."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = rows.sort_by("pos")
    new = pc.is_in(rows["pos"], pa.chunked_array(firsts["pos"].chunks, pa.int64())).to_pylist()
    out = {c: rows[c].to_pylist() for c in rows.column_names}
    symbols = []
    for i, (role, kind) in enumerate(zip(out["role"], out["kind"])):
        if kind != "gone" and kind != "blank" and not new[i]:
            out["kind"][i] = kind = "again"
        known = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols.append("" if kind == "gone" else "D" if kind in ("blank", "again") else known + ("!" if kind == "cut" else ""))
    return out, symbols


WAYS = "share int, conv_id {}, at long, ways array<long>"


def _ways(rows, firsts):
    """Of a share's first and last conversation, which may go on in others: cost and rank from each state to each."""
    import pyarrow as pa

    got, symbols = _held(rows, firsts)
    parts, layers, out = _slices(got["conv_id"]), Layers(), []
    for a, b in dict.fromkeys((*parts[:1], *parts[-1:])):
        ways = []
        for start in range(4):
            path, spent = layers.forward(start, [s for s in symbols[a:b] if s])
            for held in layers.layers[path[-1]]:
                ways += [held[0] + spent, held[1]] if held else [-1, -1]
        out.append((got["share"][a], got["conv_id"][a], got["pos"][a], ways))
    conv = rows.schema.field("conv_id").type
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.int32(), conv, pa.int64(), pa.list_(pa.int64())))], ["share", "conv_id", "at", "ways"])


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The shares of one conversation: between which states each runs. One that a share holds whole needs no plan."""
    pdf = pdf.sort_values("at")
    if len(pdf) < 2:
        return pd.DataFrame({"share": [], "at": [], "begin": [], "end": [], "last": [], "cost": []}).astype({"last": bool})
    layers = []
    for ways in pdf["ways"]:
        cell = [None if c < 0 else (int(c), int(r)) for c, r in np.asarray(ways).reshape(16, 2)]
        layers.append([tuple(cell[i : i + 4]) for i in range(0, 16, 4)])
    cost, ends = chained(layers)
    last = np.arange(len(pdf)) == len(pdf) - 1
    return pd.DataFrame({"share": pdf["share"], "at": pdf["at"], "begin": [b for b, _ in ends], "end": [e for _, e in ends], "last": last, "cost": np.where(last, cost, 0)})


FACTS = ["low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost"]
#: low, high: least and largest turn; turns: different ones; head, tail: first and last role's initial; body: repaired text.
PARTS = "conv_id {}, at long, whole boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, head string, tail string, audit string, sha string, piece int, body binary"
LEGAL = {"su", "ua", "au"}


def _repaired(got, a, b, edits, tail_from, last):
    """Audit and lines of the rows a to b."""
    codes, lines, state = [], [], edits[0]
    at = iter(edits[1])
    for i in range(a, b):
        if got["kind"][i] == "gone":
            continue
        code, after = next(at)
        codes.append(code)
        for _ in range(len(code) - 1):
            state = inserted(state, 1)
            lines.append(f"{ROLE[state]}:")
        if code[-1] != "D":
            lines.append(f"{got['role'][i] if code[-1] == 'K' else ROLE[after]}:{got['text'][i]}")
        state = after
    if last:
        for _ in range(TAILS[tail_from]):
            state = inserted(state, 1)
            codes.append("I")
            lines.append(f"{ROLE[state]}:")
    return "".join(codes), lines


def _pieces(rows, told):
    """One row for each conversation or part of one in a share; repaired text goes along in parts where it isn't whole."""
    import pyarrow as pa
    import pyarrow.compute as pc

    plan = {r["at"]: r for r in told.filter(pc.is_valid(told["at"])).to_pylist()}
    got, symbols = _held(rows, told.filter(pc.is_valid(told["pos"])))
    layers, out = Layers(), []
    for a, b in _slices(got["conv_id"]):
        live = [i for i in range(a, b) if symbols[i]]
        word = [symbols[i] for i in live]
        p = plan.get(got["pos"][a])
        path, spent = layers.forward(p["begin"] if p else EMPTY, word)
        cost, end = (p["cost"], p["end"]) if p else finish(layers.layers[path[-1]])
        begin = p["begin"] if p else EMPTY
        audit, lines = _repaired(got, a, b, (begin, layers.rebuilt(path, word, end)), end, not p or p["last"])
        kinds = [got["kind"][i] for i in live]
        turns = [got["turn"][i] for i in live if got["turn"][i] is not None]
        initial = [got["role"][i][:1] for i in live]
        facts = [min(turns, default=None), max(turns, default=None), len(set(turns)), kinds.count("blank"), kinds.count("again"), kinds.count("cut"), sum(x + y not in LEGAL for x, y in zip(initial, initial[1:])), cost if p else cost + spent]
        body = "\n".join(lines).encode()
        row = [got["conv_id"][a], got["pos"][a], p is None, *facts, initial[0] if initial else None, initial[-1] if initial else None, audit]
        if p is None:
            out.append([*row, hashlib.sha256(body).hexdigest(), 0, None])
            continue
        body = (b"\n" + body) if lines else b""
        for k in range(0, max(1, len(body)), PART):
            out.append([*(row if not k else [*row[:3], *[None] * 10, None]), None, k // PART, body[k : k + PART]])
    kinds = [rows.schema.field("conv_id").type, pa.int64(), pa.bool_(), *[pa.int64()] * 8, *[pa.string()] * 4, pa.int32(), pa.binary()]
    names = [p.split()[0] for p in PARTS.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names)


OUT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _gaps(low, high, turns):
    return 0 if low is None else high - low + 1 - turns


def _joined(batches):
    """Parts of conversations in order, one result each: text goes through the hash as it comes and isn't held."""
    import pyarrow as pa

    now, out, conv_type = None, [], None

    def told(n):
        return [n["conv_id"], _gaps(n["low"], n["high"], n["turns"]), n["blank"], n["duplicate"], n["truncated"], n["illegal"], n["cost"], "".join(n["audit"]), n["sha"].hexdigest()]

    def table():
        kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        rows = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 9, kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, [p.split()[0] for p in OUT.split(", ")])

    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for r in batch.to_pylist():
            if now is None or r["conv_id"] != now["conv_id"]:
                if now is not None:
                    out.append(told(now))
                now = dict.fromkeys(FACTS, 0) | {"conv_id": r["conv_id"], "low": None, "high": None, "tail": None, "audit": [], "sha": hashlib.sha256(), "any": False}
            if not r["piece"]:
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    now[c] += r[c]
                if r["low"] is not None:  # turns come in order: only the last one of a part may go on in the next
                    now["turns"] += r["turns"] - (r["low"] == now["high"])
                    now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
                if r["head"] is not None:
                    now["illegal"] += now["tail"] is not None and now["tail"] + r["head"] not in LEGAL
                    now["tail"] = r["tail"]
                now["audit"].append(r["audit"])
            body = r["body"]
            if body:
                now["sha"].update(body if now["any"] else body[1:])  # every part begins with a line feed, the first one without
                now["any"] = True
        yield table()
    if now is not None:
        out.append(told(now))
        yield table()


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation, null ids being one: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id, turn, role, text, gone (see `damaged`; a row with gone only says that its conversation exists). Null role
    and text should be replaced before. Rows go by turn, nulls first; at equal turns by role, then by the md5 of role and
    text, so repeated rows stay together. A role without s, u or a as initial can't be kept; an empty one neither. A conversation
    without rows gives zeros, an empty audit and the hash of nothing. Other columns are not read; an empty table gives no rows.

    No task holds a whole conversation but for two things that have no parts by nature: SHA-256, through which the text
    of a conversation in several shares is streamed in order, and the audit string of the result.
    """
    ship(rows.sparkSession)
    conv = rows.schema["conv_id"].dataType.simpleString()
    spread = _spread(rows.select("conv_id", "turn", "role", "text", "gone"))
    firsts = spread.where("kind <> 'gone'").groupBy("conv_id", "mark").agg(F.min("pos").alias("pos"))
    firsts = keep(firsts.select(F.shiftright("pos", 33).cast("int").alias("share"), "pos"))
    narrow = spread.select("share", "pos", "conv_id", "kind", "role")
    ways = narrow.groupBy("share").cogroup(firsts.groupBy("share")).applyInArrow(_ways, WAYS.format(conv))
    plan = ways.groupBy("conv_id").applyInPandas(_plan, "share int, at long, begin int, end int, last boolean, cost long")
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in names)]
    told = firsts.select("share", "pos", *none("at long", "begin int", "end int", "last boolean", "cost long")).unionByName(plan.select("share", *none("pos long"), "at", "begin", "end", "last", "cost"))
    pieces = keep(spread.drop("mark").groupBy("share").cogroup(told.groupBy("share")).applyInArrow(_pieces, PARTS.format(conv)))
    drop(spread, firsts)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    whole = pieces.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    split = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "at", "piece")
    return whole.unionByName(split.mapInArrow(_joined, OUT.format(conv)))

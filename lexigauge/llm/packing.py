"""Best-fit packing by bin completion over the histogram of piece lengths.

Pieces of one length are interchangeable, so the search needs 1,024 counts and no documents: around the largest
piece left it enumerates undominated fillings, takes each as often as the counts allow, prunes by the waste bound,
and keeps the best packing so far as incumbent, at first that of best-fit decreasing. Pieces then look up their place by their rank
within their length, which a prefix sum over partitions gives; no task ever holds a whole length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, keep, ship

CAPACITY, END_ID = 1024, 2
#: Work limits of the search (fillings kept per bin, nodes in all, nodes and branches a level of one enumeration): they
#: bound time, never the documents packed, and the packing is never worse than best fit's.
FILLINGS, NODES, STEPS, BRANCHES = 6, 4000, 300, 12

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: From so many blanks in a row on, the rank encoder's pattern may run out of stack; the tokenizers library has no such limit.
LONG_RUN = re.compile(r"\s{5000}")


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(2)
def encoder(spec: bytes):
    """The byte-level BPE of a tokenizers file. Its ids are its merge ranks, so the faster rank encoder gives the same ids; added tokens are cut out of the text first."""
    import tiktoken

    free = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in free} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in free)}
    spec = json.loads(spec)
    added = spec.get("added_tokens", [])
    if odd := [t["content"] for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]:
        raise ValueError(f"added tokens that take more than their own text: {odd}")
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(2)
def library(spec: bytes):
    """The tokenizer of a file as the tokenizers library runs it, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec.decode())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(spec: bytes, text: str) -> np.ndarray:
    """The ids of a text, whatever runs it holds."""
    if LONG_RUN.search(text):
        return np.array(library(spec).encode(text, add_special_tokens=False).ids, "<u4")
    return encoder(spec).encode_to_numpy(text, allowed_special="all").astype("<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole pieces at the end, the rest in the first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(spec, capacity):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), column(batch, "text")):
                ids = np.append(ids_of(spec.value, text.decode()), np.uint32(END_ID)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    rank = seen[n] = seen.get(n, -1) + 1
                    for o, x in zip(out, (doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), part, rank)):
                        o.append(x)
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def waste_bound(counts: np.ndarray) -> int:
    """Martello and Toth's L2: the least number of bins, for each k taking pieces over capacity - k as bins of their own."""
    cap = len(counts) - 1
    size = np.arange(cap + 1)
    total = np.cumsum(counts * size)
    number = np.cumsum(counts)
    half = cap // 2
    best = -(-int(total[-1]) // cap)
    k = np.arange(0, half + 1)
    over = number[cap] - number[cap - k]
    mid_n, mid_sum = number[cap - k] - number[half], total[cap - k] - total[half]
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    extra = -((-(small - (mid_n * cap - mid_sum))) // cap)
    return max(best, int(np.max(over + mid_n + np.maximum(0, extra))))


def fillings(counts: np.ndarray, room: int, most: int = FILLINGS, nodes: int = STEPS) -> list[tuple[int, ...]]:
    """Undominated fillings of `room`, least waste first and larger pieces first among equals.

    A filling that leaves room for another piece, or in which two pieces could be swapped for a larger one at no more
    waste, is dominated: pieces are taken in falling size and a branch is left when it can't beat the worst kept.
    """
    sizes = np.flatnonzero(counts[: room + 1])[::-1]
    if not len(sizes):
        return [()]
    found: list[tuple[int, int, tuple[int, ...]]] = []
    left = [nodes]
    reach = np.concatenate([np.cumsum((counts[sizes] * sizes)[::-1])[::-1], [0]])

    def go(i: int, room: int, taken: tuple[int, ...]) -> None:
        if left[0] <= 0 or (len(found) >= most and found[-1][0] == 0):
            return
        left[0] -= 1
        i += int(np.searchsorted(-sizes[i:], -room))
        if i >= len(sizes) or room == 0:
            found.append((room, len(taken), taken))
            found.sort()
            del found[most:]
            return
        if len(found) >= most and room - int(reach[i]) > found[-1][0]:
            return
        tried = 0
        for j in range(i, len(sizes)):
            s = int(sizes[j])
            if taken.count(s) < counts[s]:
                go(j, room - s, (*taken, s))
                tried += 1
                if tried >= BRANCHES or left[0] <= 0 or (found and found[0][0] == 0 and len(found) >= most):
                    return
        if not tried:
            found.append((room, len(taken), taken))
            found.sort()
            del found[most:]

    # an exact fill by one or two pieces comes first: no filling dominates it
    if counts[room] > 0:
        return [(room,)]
    pair = [(int(s), room - int(s)) for s in sizes if 2 * s >= room and counts[room - int(s)] > (2 * s == room)]
    if pair:
        return pair[:most]
    go(0, room, ())
    return [t for _, _, t in found] or [()]


def best_fit(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths in a sequence) of best-fit decreasing: pieces from the largest down, each to the fullest sequence it fits."""
    cap, rooms, of = len(counts) - 1, [], {}

    def put(room: int, times: int, lengths: tuple[int, ...]) -> None:
        if times:
            if room not in of:
                insort(rooms, room)
            of.setdefault(room, []).append((times, lengths))

    for s in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[s])
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                room, times, lengths = cap, -(-left // (cap // s)), ()
            else:
                room = rooms[i]
                times, lengths = of[room].pop()
                if not of[room]:
                    del of[room], rooms[i]
            # the next piece of this length goes to the same sequence as long as it fits, for that is the fullest then
            k = room // s
            full = min(times, left // k)
            put(room - k * s, full, lengths + (s,) * k)
            times, left = times - full, left - full * k
            if times and left:
                put(room - left * s, 1, lengths + (s,) * left)
                times, left = times - 1, 0
            put(room, times, lengths)
    return [x for room in rooms for x in of[room]]


def solve(counts: np.ndarray, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths in a sequence), as few sequences in all as the search finds, no more than best fit; optimal when it meets the bound."""
    counts = counts.astype(np.int64).copy()
    cap = len(counts) - 1
    bound = waste_bound(counts)
    best = best_fit(counts)
    best_n = sum(n for n, _ in best)
    if best_n <= bound:
        return best
    stack = [(counts, 0, [], None)]  # counts left, bins so far, packing so far, fillings yet to try
    first_dive = True
    while stack and nodes > 0:
        left, used, done, todo = stack.pop()
        if todo is None:
            nz = np.flatnonzero(left)
            if not len(nz):
                if used < best_n:
                    best, best_n = done, used
                first_dive = False
                if best_n <= bound:
                    break
                continue
            if used + waste_bound(left) >= best_n:
                first_dive = False
                continue
            big = int(nz[-1])
            rest = left.copy()
            rest[big] -= 1
            todo = [(big, f) for f in fillings(rest, cap - big)]
        (big, f), more = todo[0], todo[1:]
        if more:
            stack.append((left, used, done, more))
        sizes, each = np.unique((big, *f), return_counts=True)
        times = int(np.min(left[sizes] // each))
        if not f and big * 2 > cap and not left[1 : cap - big + 1].any():
            times = int(left[big])
        nxt = left.copy()
        nxt[sizes] -= each * times
        stack.append((nxt, used + times, [*done, (times, (big, *f))], None))
        nodes -= 0 if first_dive else 1
    return best


def places(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of ranks of a length that go to consecutive sequences: length, first rank, first sequence, offset."""
    at = np.zeros(len(counts), np.int64)
    runs, seq = [], 0
    for times, lengths in solve(counts):
        offset = 0
        for n in lengths:
            runs.append((n, at[n], seq, offset))
            at[n] += times
            offset += n
        seq += times
    assert (at == counts).all()
    runs.sort()
    return tuple(np.array(x, np.int64) for x in zip(*runs)) if runs else tuple(np.zeros(0, np.int64) for _ in range(4))


def _placed(plan, names):
    def run(batches):
        import pyarrow as pa

        length, lo, seq, offset = plan.value
        key = (length << 44) + lo
        for b in batches:
            n, rank = (b.column(c).to_numpy() for c in ("length", "at"))
            i = np.searchsorted(key, (n << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq[i] + rank - lo[i]), pa.array(offset[i])], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty (one piece, the end id). Repeated rows are packed each. An empty table gives no rows.
    Sequences are at most `capacity` ids, gapless from 0. Broadcast: the vocabulary file and the plan, whose size
    is bounded by capacity and the patterns in use, not by documents.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocab or default_vocab(), "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"
    pieces = keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(spec, capacity), schema))
    of = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = of.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = np.zeros(capacity + 1, np.int64)
    for r in of.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(places(counts))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(before.drop("n"), ["part", "length"]).select(*names, (F.col("rank") + F.col("before")).alias("at"))
    return ranked.mapInArrow(_placed(plan, names), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

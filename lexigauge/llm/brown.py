"""Brown class-based bigram scores.

Counting is exact and distributed. Words of at least UNIT_SHARE of all tokens are units of their own first, and all rarer
ones start together by their ending. Exchange clustering moves these units between classes: each round counts, over all
unit bigrams, how often every unit meets every class on either side, and moves a part of the units to the classes that
raise the likelihood of the class bigrams most. Units that move together don't see each other move, so a round counts only
if the likelihood did rise; parts get smaller when a sweep over all of them brings nothing.

Then every rarer word is a unit of its own too, once words included (settle): they are dealt to blocks by hash, each block
holds what its words meet, and in a round blocks send each other the classes of the words that meet and move their own by
the same gain. An ending's class is left to words that training hasn't seen, where they come before another word.

P(word | previous) = P(class | class of previous) * P(word | class). Emissions are discounted by DISCOUNT, and what
that frees is the class's probability of an unknown word; transitions are smoothed by class frequencies. The model
sums to one over the known words and "unknown".
"""

from __future__ import annotations

import zlib
from collections import Counter
from copy import copy
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array_slices, drop, hashes, keep, mix, ship, tidy, word_codes

#: Shares of all tokens: at least so frequent words are units (at most 1 / UNIT_SHARE of them) and are scored from a
#: broadcast table (at most 1 / CORE_SHARE words); for rarer ones slices of texts ask the blocks that hold counts and classes.
UNIT_SHARE, CORE_SHARE = 5e-5, 2e-6
CLASSES, ENDINGS = 64, 512
#: Units move in halves, later in smaller parts, at last in as many parts as this; a round must gain this share.
PARTS, LEAST_GAIN = 8, 1e-4
#: Unit bigrams up to which rounds count them on the driver (16 bytes each); more stay on the executors, one job a round.
HELD = 6_000_000
#: Tokens of rare words in a block of them, on average, and the turns in which a block's words move.
BLOCK_TOKENS, STEPS = 500_000, 32
#: Tokens of training, on average, whose words a block holds for the texts that ask for counts and classes.
ASKED_TOKENS = 4_000_000
#: In a context: a neighbour whose class isn't known yet.
OPEN = 255
DISCOUNT, SMOOTHING = 0.5, 5.0
#: The end of a text as a token; no word holds a blank.
END = b" "


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    out.append(END)
    return out


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def endings(words) -> np.ndarray:
    """ending() of every value of an Arrow string array."""
    if not len(words) or not words.buffers()[2]:
        return np.zeros(len(words), np.int64)
    edge = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    raw, (begin, end) = np.frombuffer(words.buffers()[2], np.uint8), (edge[:-1], edge[1:])
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (table & np.uint32(1)) * np.uint32(0xEDB88320)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        some = end - begin >= back
        x = crc[some]
        crc[some] = table[(x ^ raw[end[some] - back]) & np.uint32(255)] ^ (x >> np.uint32(8))
    return ((crc ^ np.uint32(0xFFFFFFFF)) % ENDINGS).astype(np.int64)


def _summed(parts: list, name: str):
    """One batch of all (name, n) pairs of some arrays, each value once."""
    import pyarrow as pa

    t = pa.table([pa.chunked_array([k for k, _ in parts]), pa.chunked_array([n for _, n in parts])], [name, "n"])
    t = t.group_by(name, use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    return pa.RecordBatch.from_arrays([t.column(name).combine_chunks(), t.column("n_sum").combine_chunks()], [name, "n"])


def _lined(lists):
    """Of each list of words one binary value, a word a line."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join(lists, pa.scalar(b"\n", pa.binary()))


def _words_of(lined: list[bytes]):
    """The words of such values, in one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.split_pattern(pa.array([b"\n".join(lined)], pa.binary()), b"\n").flatten() if lined else pa.array([], pa.binary())


def _by_block(words, blocks: int):
    """(blocks that words go to, how many each, the words' order by block, the words of each in one binary value)."""
    import pyarrow as pa

    words = words.cast(pa.binary())
    block = (hashes(words) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    home, many = np.unique(block, return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), words.take(pa.array(order)))
    return home.astype(np.int32), many.astype(np.int32), order, _lined(lists)


COUNTED = "block int, words binary, n binary"


def _count(blocks: int):
    """Words and their counts in each batch, a row for each block; _count_all() adds them up."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            texts, parts = batch.column("text"), [(pa.array([END], pa.binary()).cast(pa.string()), pa.array([len(batch)], pa.int64()))]
            for a, b in array_slices(texts):
                _, kind, _, kinds = word_codes(texts.slice(a, b - a))
                n = np.bincount(kind, minlength=len(kinds))
                some = pa.array(np.flatnonzero(n))
                parts.append((kinds.take(some), pa.array(n[n > 0])))
            got = _summed(parts, "word")
            home, many, order, lined = _by_block(got.column("word"), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(home), lined, _bytes(got.column("n").to_numpy()[order], many)], [x.split()[0] for x in COUNTED.split(", ")])

    return run


def _count_all(table):
    import pyarrow as pa

    words = _words_of(table.column("words").to_pylist()).cast(pa.string())
    return pa.Table.from_batches([_summed([(words, pa.array(_joined(table, "n", np.int64)))], "word")])


class Words:
    """Core words with counts, and the units clustered first: 0 is the end, then frequent words, then endings for all others."""

    def __init__(self, rows, total: int):
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.listed: dict = {}
        self.index = {w.encode(): i for i, (w, _) in enumerate(rows)}
        self.counts = np.array([n for _, n in rows], np.int64)
        frequent = [w.encode() for w, n in rows if n >= UNIT_SHARE * total and w.encode() != END]
        self.n_units = 1 + len(frequent) + ENDINGS
        self.frequent = unit = {END: 0} | {w: 1 + i for i, w in enumerate(frequent)}
        self.first_ending = 1 + len(frequent)
        self.unit = np.array([unit.get(w.encode(), -1) for w, _ in rows], np.int64)
        for i, (w, _) in enumerate(rows):
            if self.unit[i] < 0:
                self.unit[i] = self.first_ending + ending(w.encode())

    def place(self, kinds, name: str) -> np.ndarray:
        """Of every value of an Arrow string array, and of the end after them, its number in index or frequent, or -1."""
        import pyarrow as pa
        import pyarrow.compute as pc

        index = getattr(self, name)
        if name not in self.listed:
            self.listed[name] = pa.array(sorted(index, key=index.get), pa.binary()).cast(pa.string())
        at = pc.index_in(kinds.cast(pa.string()), value_set=self.listed[name]).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.append(at, index.get(END, -1)).astype(np.int64)

    def look(self, flat: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the core index (-1: none) and the unit."""
        core = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        rare = np.flatnonzero(core < 0)
        units = self.unit[core] if len(self.unit) else np.full(len(flat), -1)
        units[rare] = [self.first_ending + ending(flat[i]) for i in rare]
        return core, units

    def settled(self, cls: np.ndarray, classes: dict[str, int]) -> tuple[Words, np.ndarray]:
        """These words with a unit for each core word, and the classes of units; classes: of the core words that aren't frequent."""
        out = copy(self)
        out.listed = {}
        out.unit = np.array([0 if w == END else 1 + i for w, i in self.index.items()], np.int64)
        out.first_ending = 1 + len(self.index)
        own = [int(cls[self.frequent[w]]) if w in self.frequent else classes[w.decode()] for w in self.index]
        return out, np.concatenate([[0], np.array(own, np.int64), cls[self.first_ending :]])


PAIRED = "block int, key binary, n binary"


def _bigrams(words, blocks: int):
    """Unit bigrams and their counts in each batch, a row for each block; _pair_all() adds them up."""

    def run(batches):
        import pyarrow as pa

        w: Words = words.value
        for batch in batches:
            texts, parts = batch.column("text"), [(pa.array([], pa.int64()), pa.array([], pa.int64()))]
            for a, b in array_slices(texts):
                _, flat, kinds = _stream(texts.slice(a, b - a))
                unit = w.place(kinds, "frequent")
                unit = np.where(unit < 0, w.first_ending + np.concatenate([endings(kinds), [0]]), unit)
                u = np.concatenate([[0], unit[flat]])
                got = pa.array(u[:-1] * w.n_units + u[1:]).value_counts()
                parts.append((got.field("values"), got.field("counts")))
            got = _summed(parts, "key")
            key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
            block = (mix(key.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            home, many = np.unique(block, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), _bytes(key[order], many), _bytes(n[order], many)], [x.split()[0] for x in PAIRED.split(", ")])

    return run


def _pair_all(table):
    import pyarrow as pa

    return pa.Table.from_batches([_summed([tuple(pa.array(_joined(table, x, np.int64)) for x in ("key", "n"))], "key")])


def _add_contexts(total, cls, n_units, key, n):
    u, v = key // n_units, key % n_units
    for at in ((u * CLASSES + cls[v]) * 2, (v * CLASSES + cls[u]) * 2 + 1):
        total += np.bincount(at, n, len(total))


def _contexts(cls, n_units):
    """Of each unit, how often each class follows (even cells) and goes before (odd ones)."""

    def run(batches):
        import pyarrow as pa

        c, size = cls.value, CLASSES
        total = np.zeros(n_units * size * 2, np.int64)
        for b in batches:
            key, n = b.column("key").to_numpy(), b.column("n").to_numpy()
            u, v = key // n_units, key % n_units
            total += np.bincount((u * size + c[v]) * 2, n, len(total)).astype(np.int64)
            total += np.bincount((v * size + c[u]) * 2 + 1, n, len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    return run


def _xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(g: np.ndarray) -> float:
    """What exchange raises: the class bigrams' log likelihood, up to what no class changes."""
    return float(_xlogx(g).sum() - _xlogx(g.sum(0)).sum() - _xlogx(g.sum(1)).sum())


def exchange(cls: np.ndarray, right: np.ndarray, left: np.ndarray, turn: int, parts: int = 2) -> np.ndarray:
    """One part's sweep: every parts-th unit moves to its best class; unit 0 (the end) and class 0 (its own) stay."""
    cls = cls.copy()
    g = np.zeros((CLASSES, CLASSES))
    np.add.at(g, cls, right)
    n = right.sum(1)
    for u in np.argsort(-n, kind="stable"):
        if u == 0 or n[u] == 0 or (u + turn) % parts:
            continue
        a, r, l = cls[u], right[u], left[u]  # noqa: E741
        g[a] -= r
        g[:, a] -= l
        np.maximum(g, 0, out=g)
        row, col = g.sum(1), g.sum(0)
        gain = (_xlogx(g + r) - _xlogx(g)).sum(1) + (_xlogx(g.T + l) - _xlogx(g.T)).sum(1)
        gain -= _xlogx(row + n[u]) - _xlogx(row) + _xlogx(col + n[u]) - _xlogx(col)
        gain[0] = -np.inf
        b = int(np.argmax(gain))
        if gain[b] <= gain[a] + 1e-9:
            b = a
        cls[u] = b
        g[b] += r
        g[:, b] += l
    return cls


def cluster(spark, bigrams: DataFrame, n_units: int):
    """(class of each unit, class bigram counts, tokens of each unit) when a sweep in PARTS parts raises the likelihood no more.

    Each kept round raises it, so this ends; nothing but the bigrams' contexts by class, a table of fixed size, leaves the executors.
    """

    held = None
    if bigrams.count() <= HELD:
        got = bigrams.select("key", "n").toArrow()
        held = got.column("key").to_numpy(), got.column("n").to_numpy()

    def counted(cls):
        m = np.zeros(n_units * CLASSES * 2)
        if held:
            for at in range(0, len(held[0]), 1 << 19):
                _add_contexts(m, cls, n_units, *(x[at : at + (1 << 19)] for x in held))
        else:
            sent = spark.sparkContext.broadcast(cls)
            got = bigrams.mapInArrow(_contexts(sent, n_units), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
            sent.unpersist()
            m[got.column("at").to_numpy()] = got.column("n").to_numpy()
        right, left = m.reshape(n_units, CLASSES, 2)[:, :, 0], m.reshape(n_units, CLASSES, 2)[:, :, 1]
        g = np.zeros((CLASSES, CLASSES))
        np.add.at(g, cls, right)
        return likelihood(g), cls, g, right, left

    best = counted(np.concatenate([[0], 1 + np.arange(n_units - 1) % (CLASSES - 1)]))
    parts, turn, idle = 2, 0, 0
    while parts <= PARTS:
        nxt = exchange(best[1], best[3], best[4], turn, parts)
        turn, idle = turn + 1, idle + 1
        if (nxt != best[1]).any():
            now = counted(nxt)
            if now[0] > best[0] + LEAST_GAIN * abs(best[0]):
                best, idle = now, 0
        if idle >= parts:
            parts, idle = parts * 2, 0
    _, cls, g, _, left = best
    return cls, g, left.sum(1)


def _stream(texts):
    """All tokens of an Arrow string array: of each text how many, of each token its kind (the last is the end), the kinds but the end."""
    owner, kind, _, kinds = word_codes(texts)
    size = np.bincount(owner, minlength=len(texts)) + 1
    flat = np.full(size.sum(), len(kinds))
    flat[np.arange(len(owner)) + owner] = kind
    return size, flat, kinds


def _ids(kinds, salt: int) -> np.ndarray:
    """64-bit names of words; settle() sees to it that all differ."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return hashes(pc.binary_join_element_wise(f"{salt} ", kinds.cast(pa.string()), "") if salt else kinds)


def _bytes(data: np.ndarray, sizes):
    """A binary array of values of those many items each."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _values(binary, dtype) -> np.ndarray:
    """All items of a binary array without nulls, in one."""
    if not len(binary) or not binary.buffers()[2]:
        return np.zeros(0, dtype)
    edge = np.frombuffer(binary.buffers()[1], np.int32, len(binary) + 1, binary.offset * 4)
    return np.frombuffer(binary.buffers()[2], np.uint8)[edge[0] : edge[-1]].view(dtype)


def _joined(table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


DEALT = "block int, word binary, start binary, ctx_at binary, ctx binary, link_at binary, link_to binary, link_side binary"


def _dealt(words, cls, blocks: int, salt: int):
    """Of the rare words of each slice and block: names and first classes, frequent neighbours' sides and classes, rare neighbours."""

    def run(batches):
        import pyarrow as pa

        w, c = words.value, cls.value
        for batch in batches:
            texts = batch.column("text")
            for a, b in array_slices(texts):
                _, flat, kinds = _stream(texts.slice(a, b - a))
                unit = w.place(kinds, "frequent")
                rare = np.flatnonzero((unit < 0) & (np.bincount(flat, minlength=len(unit)) > 0))  # kinds may hold an empty one that no token is of
                if not len(rare):
                    continue
                h = _ids(kinds, salt)
                order = rare[np.lexsort((h[rare], h[rare] % np.uint64(blocks)))]  # by block, then by name
                block = (h[order] % np.uint64(blocks)).astype(np.int64)
                edge = np.searchsorted(block, np.arange(blocks + 1))
                start = c[w.first_ending + endings(kinds)[order]].astype(np.uint8)
                spot = np.full(len(unit), -1)
                spot[order] = np.arange(len(order)) - edge[block]
                of = np.full(len(unit), -1)
                of[order] = block
                u, at, blk = unit[flat], spot[flat], of[flat]
                here = np.flatnonzero(at >= 0)
                me, other = np.concatenate([here, here]), np.concatenate([here + 1, here - 1])  # an end stands before a text and after it
                side = np.repeat([0, 1], len(here))
                known = u[other] >= 0

                def dealt(wanted):
                    i = np.flatnonzero(wanted)
                    i = i[np.argsort(blk[me[i]], kind="stable")]
                    return i, np.bincount(blk[me[i]], minlength=blocks)

                i, many = dealt(known)
                j, links = dealt(~known)
                cols = [
                    _bytes(h[order], np.diff(edge)), _bytes(start, np.diff(edge)),
                    _bytes(at[me[i]].astype(np.int32), many), _bytes((side[i] * CLASSES + c[u[other[i]]]).astype(np.uint8), many),
                    _bytes(at[me[j]].astype(np.int32), links), _bytes(h[flat[other[j]]], links), _bytes(side[j].astype(np.uint8), links),
                ]
                some = np.flatnonzero(np.diff(edge))
                cols = [pa.array(np.arange(blocks), pa.int32()), *cols]
                yield pa.RecordBatch.from_arrays([x.take(pa.array(some)) for x in cols], [x.split()[0] for x in DEALT.split(", ")])

    return run


BLOCK = "block int, word binary, start binary, key binary, n binary, in_at binary, in_side binary, in_n binary, out_at binary, out_to binary, out_many binary"


def _merged(blocks: int):
    """One row of a block. Links in come by (block, word there, word here, side); the sender's links out stand in the same order."""

    def run(table):
        import pyarrow as pa

        word, at = np.unique(_joined(table, "word", np.uint64), return_inverse=True)
        start = np.zeros(len(word), np.uint8)
        start[at] = _joined(table, "start", np.uint8)
        begin = np.cumsum([0, *(len(x) // 8 for x in table.column("word").to_pylist())])[:-1]
        mine = lambda name: at[np.repeat(begin, [len(x) // 4 for x in table.column(name).to_pylist()]) + _joined(table, name, np.int32)]
        key, n = np.unique(mine("ctx_at") * (2 * CLASSES) + _joined(table, "ctx", np.uint8), return_counts=True)
        far, r = np.unique(_joined(table, "link_to", np.uint64), return_inverse=True)
        home = (far % np.uint64(blocks)).astype(np.int64)
        by_home = np.argsort(home, kind="stable")
        rank = np.empty(len(far), np.int64)
        rank[by_home] = np.arange(len(far))
        link, link_n = np.unique((rank[r] * len(word) + mine("link_at")) * 2 + _joined(table, "link_side", np.uint8), return_counts=True)
        side, here, there = link % 2, link // 2 % len(word), link // 2 // len(word)
        there_home = home[by_home][there]
        out = np.lexsort((1 - side, there, here, there_home))
        to, many = np.unique(there_home, return_counts=True)  # links out stand by block
        cells = [word, start, key.astype(np.int64), n.astype(np.int32), here.astype(np.int32), side.astype(np.uint8), link_n.astype(np.int32), here[out].astype(np.int32), to.astype(np.int32), many.astype(np.int64)]
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], [x.split()[0] for x in BLOCK.split(", ")])

    return run


POST = "to int, sender int, classes binary"
POSTED = [x.split()[0] for x in POST.split(", ")]


def _post(table, cls: np.ndarray):
    """What a block sends: to itself its words' classes, to each other block those of the words that meet words there."""
    import pyarrow as pa

    block, at = table.column("block")[0].as_py(), _joined(table, "out_at", np.int32)
    where, many = _joined(table, "out_to", np.int32), _joined(table, "out_many", np.int64)
    sizes = np.concatenate([[len(cls)], many])
    return pa.table([pa.array(np.concatenate([[block], where]), pa.int32()), pa.array(np.concatenate([[-1], np.full(len(where), block)]), pa.int32()), _bytes(np.concatenate([cls, cls[at]]), sizes)], POSTED)


def _first_post(batches):
    import pyarrow as pa

    for batch in batches:
        for i in range(len(batch)):
            t = pa.Table.from_batches([batch.slice(i, 1)])
            yield from _post(t, _joined(t, "start", np.uint8)).to_batches()


def _received(table, post):
    """A block's words' classes, those of the words of its links in, and the links' sizes, sides and places."""
    got = dict(zip(post.column("sender").to_pylist(), post.column("classes").to_pylist()))
    cls = np.frombuffer(got.pop(-1), np.uint8).astype(np.int64)
    there = np.frombuffer(b"".join(got[k] for k in sorted(got)), np.uint8).astype(np.int64)
    return cls, there, _joined(table, "in_at", np.int32), _joined(table, "in_side", np.uint8), _joined(table, "in_n", np.int32)


def _counted(table, post):
    """Class bigrams of a block: those that a word of it begins, and those of a frequent word and one of it."""
    import pyarrow as pa

    cls, there, at, side, n = _received(table, post)
    key, many = _joined(table, "key", np.int64), _joined(table, "n", np.int32)
    mine, code = cls[key // (2 * CLASSES)], key % (2 * CLASSES)
    cell = np.where(code < CLASSES, mine * CLASSES + code, (code - CLASSES) * CLASSES + mine)
    right = side == 0
    g = np.bincount(cell, many, CLASSES**2) + np.bincount(cls[at[right]] * CLASSES + there[right], n[right], CLASSES**2)
    some = np.flatnonzero(g)
    return pa.table([pa.array(some), pa.array(g[some].astype(np.int64))], ["cell", "n"])


def moved(cls, at, code, n, g, may, scale: float, steps: int = STEPS):
    """New classes of words by their contexts: at (ascending) the word, code its neighbour's class, CLASSES more on the left.

    Gains are those of exchange(). Words move in turns and see what the turns before did: scale times of it, for as many
    blocks do alike and words are dealt by hash. may: which words may move.
    """
    cls, g, top = cls.copy(), g.copy(), 8
    size = np.bincount(at, np.where(code < CLASSES, n, 0), len(cls)).astype(np.int64)
    size_left = np.bincount(at, np.where(code < CLASSES, 0, n), len(cls)).astype(np.int64)
    edge = np.searchsorted(at, np.arange(len(cls) + 1))
    small, sizes = np.arange(1, top)[:, None, None], np.arange(65)[:, None]
    for i, j in zip(*(lambda x: (x[:-1], x[1:]))(np.unique(np.linspace(0, len(cls), steps + 1).astype(np.int64)))):
        row, col = g.sum(1), g.sum(0)
        both = np.concatenate([g.T, g])  # of a code, the cell of each class
        had, had_row, had_col = _xlogx(both), _xlogx(row), _xlogx(col)
        rise = _xlogx(both + small) - had  # by n, from 1
        cost, cost_left = _xlogx(row + sizes) - had_row, _xlogx(col + sizes) - had_col
        for a in range(i, j, 1024):  # a thousand words at a time, for memory
            b = min(a + 1024, j)
            e = slice(edge[a], edge[b])
            w, k, m = at[e] - a, code[e], n[e]
            # a word has each code once at most: those met once, most of all, are a table of zeros and ones
            one = m == 1
            met = np.zeros(((b - a), 2 * CLASSES))
            met[w[one], k[one]] = 1
            gain = met @ rise[0]
            if len(more := np.flatnonzero(~one)):
                per = rise[np.minimum(m[more], top - 1) - 1, k[more]]
                if len(many := np.flatnonzero(m[more] >= top)):
                    x = k[more[many]]
                    per[many] = _xlogx(both[x] + m[more[many], None]) - had[x]
                first = np.flatnonzero(np.diff(w[more], prepend=-1))
                gain[w[more[first]]] += np.add.reduceat(per, first, axis=0)
            s, t, own = size[a:b], size_left[a:b], cls[a:b].copy()
            gain -= cost[np.minimum(s, 64)]
            gain -= cost_left[np.minimum(t, 64)]
            for x, table, base, had_base, size_of in ((np.flatnonzero(s > 64), cost, row, had_row, s), (np.flatnonzero(t > 64), cost_left, col, had_col, t)):
                gain[x] += table[64] - (_xlogx(base + size_of[x, None]) - had_base)
            cell = both[k, own[w]]
            stay = np.bincount(w, had[k, own[w]] - _xlogx(np.maximum(cell - m, 0)), b - a)
            stay -= had_row[own] - _xlogx(np.maximum(row[own] - s, 0)) + had_col[own] - _xlogx(np.maximum(col[own] - t, 0))
            gain[np.arange(b - a), own] = stay
            gain[:, 0] = -np.inf
            best = gain.argmax(1)
            go = may[a:b] & (best != own) & (gain[np.arange(b - a), best] > stay + 1e-9)
            cls[a:b][go] = best[go]
            on = go[w]
            k, m, by = k[on], m[on] * scale, w[on]
            for x, sign in ((own[by], -1.0), (best[by], 1.0)):
                cell = np.where(k < CLASSES, x * CLASSES + k, (k - CLASSES) * CLASSES + x)
                g += np.bincount(cell, m * sign, CLASSES**2).reshape(CLASSES, CLASSES)
        np.maximum(g, 0, out=g)
    return cls


def _move(g, blocks: int, parts: int, turn: int):
    def run(table, post):
        cls, there, at, side, n = _received(table, post)
        key, many = _joined(table, "key", np.int64), _joined(table, "n", np.int32)
        key = np.concatenate([key, at * (2 * CLASSES) + side.astype(np.int64) * CLASSES + there])
        key, to = np.unique(key, return_inverse=True)
        n = np.bincount(to, np.concatenate([many, n])).astype(np.int64)
        may = (np.arange(len(cls)) + turn) % parts == 0
        return _post(table, moved(cls, key // (2 * CLASSES), key % (2 * CLASSES), n, g.value, may, blocks).astype(np.uint8))

    return run


def _classes(table, post):
    import pyarrow as pa

    own = dict(zip(post.column("sender").to_pylist(), post.column("classes").to_pylist()))[-1]
    return pa.table([pa.array(_joined(table, "word", np.int64)), pa.array(np.frombuffer(own, np.uint8).astype(np.int32))], ["h", "k"])


def _cells(cls, n_units: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            key = b.column("key").to_numpy()
            g = np.bincount(cls.value[key // n_units] * CLASSES + cls.value[key % n_units], b.column("n").to_numpy(), CLASSES**2)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES**2)), pa.array(g.astype(np.int64))], ["cell", "n"])

    return run


def _named(salt: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            h = _ids(b.column("word"), salt).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(h)], ["word", "n", "h"])

    return run


def _square(df: DataFrame) -> np.ndarray:
    got = df.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    g = np.zeros(CLASSES**2)
    g[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return g.reshape(CLASSES, CLASSES)


def settle(train: DataFrame, bigrams: DataFrame, rare: DataFrame, words, cls: np.ndarray):
    """(word, n, k: class) of every rare word and the class bigrams, from the classes of frequent words and endings.

    rare: all words with counts that aren't frequent. A round moves all words; one that lowers the likelihood is undone. When
    a sweep gains less than LEAST_GAIN of the likelihood, this ends, or parts get smaller if a round lost more than that, for
    words that meet moved together.
    """
    spark, w = train.sparkSession, words.value
    n_words, n_tokens = rare.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sc, u = spark.sparkContext, F.floor(F.col("key") / w.n_units)
    sent = sc.broadcast(cls)
    plain = (u < w.first_ending) & (F.col("key") % w.n_units < w.first_ending)
    rest = _square(bigrams.select("key", "n").where(plain).mapInArrow(_cells(sent, w.n_units), "cell long, n long"))
    if not n_words:
        return rare.select("word", "n", F.lit(0).alias("k")), rest
    blocks, salt = -(-n_tokens // BLOCK_TOKENS), 0
    while True:
        dealt = train.mapInArrow(_dealt(words, sent, blocks, salt), DEALT)
        home = keep(dealt.groupBy("block").applyInArrow(_merged(blocks), BLOCK))
        del dealt
        tidy(spark)
        if home.agg(F.sum(F.length("word"))).first()[0] == 8 * n_words:
            break
        drop(home)  # two words share a name: all get others
        salt += 1
    held = home.select("block", "key", "n", "in_at", "in_side", "in_n").groupBy("block")
    counted = lambda post: rest + _square(held.cogroup(post.groupBy("to")).applyInArrow(_counted, "cell long, n long"))
    post = keep(home.select("block", "start", "out_at", "out_to", "out_many").mapInArrow(_first_post, POST))
    g = counted(post)
    parts, best = 1, likelihood(g)
    while parts <= PARTS:
        before, fell = best, False
        for turn in range(parts):
            sent_g = sc.broadcast(g)
            moving = home.drop("word", "start").groupBy("block").cogroup(post.groupBy("to"))
            nxt = keep(moving.applyInArrow(_move(sent_g, blocks, parts, turn), POST))
            g_next = counted(nxt)
            sent_g.unpersist()
            now = likelihood(g_next)
            if now > best:
                drop(post)
                post, g, best = nxt, g_next, now
            else:
                drop(nxt)
                fell = fell or best - now > LEAST_GAIN * abs(best)
            tidy(spark)
        if best - before <= LEAST_GAIN * abs(before):
            if not fell:
                break
            parts *= 2
    own = home.select("block", "word").groupBy("block").cogroup(post.where("sender = -1").groupBy("to")).applyInArrow(_classes, "h long, k int")
    out = keep(rare.mapInArrow(_named(salt), "word string, n long, h long").join(own, "h").select("word", "n", "k"))
    drop(home, post)
    tidy(spark)
    return out, g


CODED = "slice long, doc_id binary, flag binary, n_tokens binary, n_core binary, base binary, score binary, kind binary, place binary, before binary, after binary, ending binary, asked array<struct<block:int,many:int,words:binary>>"


def _scored(words, model):
    """A row for each slice of texts: what core words decide, the places of all others, and those words once each, by block, as asked for."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        w: Words = words.value
        cls, step, _, emit, base_of = model.value
        emit, base_of = (x if len(x) else np.zeros(1) for x in (emit, base_of))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, ids, held = batch.column("text"), batch.column("doc_id"), batch.column("held_out")
            for a, b in array_slices(texts):
                size, flat, kinds = _stream(texts.slice(a, b - a))
                core = w.place(kinds, "index")
                of = np.where(core < 0, OPEN, cls[w.unit[core]] if len(w.unit) else OPEN)
                of[-1] = 0
                owner, c = np.repeat(np.arange(b - a), size), of[flat]
                before = np.concatenate([[0], c[:-1]])  # an end's class is 0
                known = (core >= 0)[flat]
                at = np.maximum(core, 0)[flat]
                met = np.flatnonzero(known & (before < OPEN))
                score = np.bincount(owner, np.where(known, emit[at], 0.0), b - a) + np.bincount(owner[met], step[before[met], c[met]], b - a)
                base, n_core = np.bincount(owner, np.where(known, base_of[at], 0.0), b - a), np.bincount(owner, known, b - a)
                # the others, once per slice, for the blocks that hold their counts and classes
                r = np.flatnonzero(~known)
                after = c[np.minimum(r + 1, len(c) - 1)]
                if core[-1] < 0:  # only without a model
                    after[flat[r] == len(kinds)] = 0
                rare = np.flatnonzero(np.bincount(flat[r], minlength=len(of)))
                asked = pa.concat_arrays([kinds.cast(pa.binary()), pa.array([END], pa.binary())]).take(pa.array(rare))
                home, many, order, lined = _by_block(asked, w.blocks)
                spot = np.empty(len(of), np.int32)
                spot[rare[order]] = np.arange(len(rare))
                ends = np.concatenate([cls[w.first_ending + endings(kinds)], [0]])[rare[order]].astype(np.uint8)
                asked = pa.StructArray.from_arrays([pa.array(home), pa.array(many), lined], ["block", "many", "words"])
                some = ids.slice(a, b - a)
                null, flag = some.is_null().to_numpy(zero_copy_only=False), held.slice(a, b - a).to_numpy(zero_copy_only=False)
                cells = [
                    some.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), (flag.astype(bool) + 2 * null).astype(np.uint8), size.astype(np.int64), n_core.astype(np.int64), base, score,
                    spot[flat[r]], r.astype(np.int32), before[r].astype(np.uint8), after.astype(np.uint8), ends,
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in cells), pa.ListArray.from_arrays(pa.array([0, len(asked)], pa.int32()), asked)],
                    [x.split()[0] for x in CODED.split(", ")])
                row += 1

    return run


KNOWN = "block int, words binary, n binary, k binary"


def _packed(blocks: int):
    """Words with counts and classes, a row for each block and batch."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            home, many, order, lined = _by_block(b.column("word"), blocks)
            n, k = (b.column(x).to_numpy(zero_copy_only=False)[order] for x in ("c", "k"))
            yield pa.RecordBatch.from_arrays([pa.array(home), lined, _bytes(n.astype(np.int64), many), _bytes(k.astype(np.uint8), many)], [x.split()[0] for x in KNOWN.split(", ")])

    return run


ANSWER = "slice long, block int, n binary, k binary"


def _answers(asked, known):
    """Counts (0: not seen in training) and classes of the words that slices ask a block for."""
    import pyarrow as pa
    import pyarrow.compute as pc

    asked = asked.combine_chunks()
    at = pc.index_in(_words_of(asked.column("words").to_pylist()), value_set=_words_of(known.column("words").to_pylist())).fill_null(-1).to_numpy(zero_copy_only=False)
    n, k = (np.concatenate([_joined(known, x, kind), np.zeros(1, kind)])[at] for x, kind in (("n", np.int64), ("k", np.uint8)))
    many = asked.column("many").to_numpy()
    return pa.table([asked.column("slice"), asked.column("block"), _bytes(n, many), _bytes(k, many)], [x.split()[0] for x in ANSWER.split(", ")])


def _resolved(model, log_base: float):
    """The texts of a slice, by what its core words decided and the counts and classes of all others."""

    def run(coded, answers):
        import pyarrow as pa

        _, step, unknown, _, _ = model.value
        col = lambda x, kind: _joined(coded, x, kind)
        answers = answers.sort_by("block")
        n, k = _joined(answers, "n", np.int64), _joined(answers, "k", np.uint8)
        k = np.where(n > 0, k, col("ending", np.uint8)).astype(np.int64)
        size, flag = col("n_tokens", np.int64), col("flag", np.uint8)
        kind, place, before, after = col("kind", np.int32), col("place", np.int32), col("before", np.uint8).astype(np.int64), col("after", np.uint8)
        owner = np.searchsorted(np.cumsum(size), place, side="right")
        mine, n = k[kind], n[kind]
        before[1:] = np.where(before[1:] == OPEN, mine[:-1], before[1:])  # only such a word of the same text stands open before one
        x = np.where(n > 0, step[before, mine] + np.log10(np.maximum(n - DISCOUNT, DISCOUNT)), unknown[before])
        x += np.where(after < OPEN, step[mine, np.minimum(after, CLASSES - 1)], 0.0)
        more = lambda y: np.bincount(owner, y, len(size))
        ids = pa.array(col("doc_id", np.int64), mask=(flag & 2) > 0)
        cells = [ids, pa.array((flag & 1) > 0), pa.array(size), pa.array(col("n_core", np.int64) + more(n > 0).astype(np.int64)), pa.array(col("base", np.float64) + more(np.log10(n + 0.5) - log_base)), pa.array(col("score", np.float64) + more(x))]
        return pa.table(cells, ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return run


def score(docs: DataFrame, folds: int = 5, test_fold: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_token.

    Learns from the rows whose crc32(doc_id as text) mod folds isn't test_fold (a null doc_id learns). A null text is
    empty: one token, the end. With nothing to learn from, score is base_score. Broadcast: at most 1 / CORE_SHARE
    words with counts and classes, and classes of ENDINGS endings; slices of texts ask blocks of words for those of rarer ones, each word once.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == test_fold, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", "text", held.alias("held_out"))
    train = rows.where(~F.col("held_out")).select("text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = 2 * parts
    counts = keep(train.mapInArrow(_count(blocks), COUNTED).groupBy("block").applyInArrow(_count_all, "word string, n long"))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    is_core = (F.col("n") >= max(1.0, CORE_SHARE * total)) | (F.col("word") == END.decode())
    core = counts.where(is_core).toArrow() if total else None
    w = Words(list(zip(core.column("word").to_pylist(), core.column("n").to_pylist())) if core else [], total)
    w.blocks = max(-(-total // ASKED_TOKENS), parts)
    words = spark.sparkContext.broadcast(w)
    log_base = float(np.log10(total + 0.5 * (distinct + 1)))
    if total:
        bigrams = keep(train.mapInArrow(_bigrams(words, blocks), PAIRED).groupBy("block").applyInArrow(_pair_all, "key long, n long"))
        cls, _, _ = cluster(spark, bigrams, w.n_units)
        rare, g = settle(train, bigrams, counts.where((F.col("n") < UNIT_SHARE * total) & (F.col("word") != END.decode())), words, cls)
        drop(bigrams)
        tidy(spark)
        # distinct words of each class
        types = np.bincount(cls[: w.first_ending], minlength=CLASSES).astype(float)
        for r in rare.groupBy("k").count().collect():
            types[r["k"]] += r["count"]
        n_class, freed = g.sum(0), DISCOUNT * types
        p = (n_class + 1) / (n_class.sum() + CLASSES)
        p /= p.sum()
        trans = (g + SMOOTHING * p) / (g.sum(1, keepdims=True) + SMOOTHING)
        live = n_class > 0
        trans = np.where(live, trans, 0.0)
        trans /= trans.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            step = np.where(trans > 0, np.log10(np.maximum(trans, 1e-300)), -300.0) - np.log10(np.maximum(n_class, 1e-9))
            unknown = np.log10(trans @ np.where(live, freed / np.maximum(n_class, 1e-9), 0.0))
        emit, base_of = np.log10(w.counts - DISCOUNT), np.log10(w.counts + 0.5) - log_base
        named = rare.where(is_core).select("word", "k").toArrow()
        w, cls = w.settled(cls, dict(zip(named.column("word").to_pylist(), named.column("k").to_pylist())))
        words = spark.sparkContext.broadcast(w)
        rare = rare.where(~is_core).select("word", F.col("n").alias("c"), "k")
        model = (cls, np.where(live, step, -300.0), unknown, emit, base_of)
    else:
        rare = counts.select("word", F.col("n").alias("c"), F.lit(0).alias("k"))
        model = (np.zeros(w.n_units, np.int64), np.zeros((CLASSES, CLASSES)), np.full(CLASSES, np.log10(0.5) - log_base), np.zeros(0), np.zeros(0))
    sent = spark.sparkContext.broadcast(model)
    coded = keep(rows.mapInArrow(_scored(words, sent), CODED))
    asked = coded.select("slice", F.explode("asked").alias("a")).select("slice", "a.block", "a.many", "a.words").groupBy("block")
    answers = asked.cogroup(rare.mapInArrow(_packed(w.blocks), KNOWN).groupBy("block")).applyInArrow(_answers, ANSWER)
    scored = coded.drop("asked").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_resolved(sent, log_base), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", (-F.col("score") / F.col("n_tokens") / float(np.log10(2))).alias("bits_per_token"))

"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered from rare to frequent by a sketch of all counts, ties by hash; two sets
whose Jaccard similarity reaches the threshold share a word among the first few of each (the prefix). Equal sets are one
class. Classes that share a prefix word meet in its list; pairs pass the length filter, the positional filter and a
bit-parity bound on their overlap within it. Lines that may be similar are named by the least line of their component in
the list (their leader), and have their words compared with those of the same leader. No link between different sets is
lost, and none is a row: lines get counts.
A line goes if an earlier line (by doc_id, then hash of the text, then place) has the same set or a similar one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, array_slices, drop, keep, mix, ship, spots, tidy, word_codes

SIMILARITY = 0.8
#: Lines of fewer distinct words stay: only those without any.
LEAST_WORDS = 1
#: Cells that count words by hash, log2. Words that share one are ordered as if they were as frequent as both together.
CELLS = 24
#: Cells are summed in blocks of so many, log2.
BLOCK = 12
#: Postings of a word that meet in one place; those of a more frequent one are dealt in shares, each two of which meet.
LIST = 2048
#: Lines of a group whose words are compared in one place; larger groups are dealt in the same way.
SIDE, SIDE_BYTES = 512, 16 << 20
#: Cells of a matrix in a comparison.
GRID = 8 << 20
#: Pairs that are filtered at a time, about.
PAIRS = 1 << 19
#: Bits of the filter that tells which lines to fetch again for comparison; a chance hit costs time only.
BITS = 1 << 26


def prefix_length(n, threshold: float):
    """Words of a set of n that must hold one in common with any other set as similar; none if only equal sets are that similar."""
    n = np.asarray(n)
    p = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    return np.where(n < threshold * (n + 1) - 1e-9, 0, p)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a log scale of a byte: 0 for none or one, then four steps a doubling."""
    return np.where(counts > 1, 1 + np.floor(4 * np.log2(np.maximum(counts, 2)) - 4), 0).clip(0, 255).astype(np.uint8)


def _count(batches):
    """The cell counts of a task's words, by block: places in the block and counts."""
    import pyarrow as pa

    def told():
        for k in np.unique(np.flatnonzero(cells) >> BLOCK).tolist():
            mine = cells[k << BLOCK : (k + 1) << BLOCK]
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([mine[at].astype("<u4").tobytes()], pa.binary())], ["block", "at", "n"])

    cells, seen = np.zeros(1 << CELLS, np.uint32), 0
    for batch in batches:
        texts = batch.column("text")
        for a, b in array_slices(texts):
            _, kind, code, _ = word_codes(texts.slice(a, b - a))
            n = np.bincount(kind, minlength=len(code))
            np.add.at(cells, (code >> np.uint64(64 - CELLS)).astype(np.int64), n.astype(np.uint32))
            seen += len(kind)
            if seen > 1 << 30:
                yield pa.Table.from_batches(told()).combine_chunks().to_batches()[0]
                cells[:], seen = 0, 0
    if seen:
        yield pa.Table.from_batches(told()).combine_chunks().to_batches()[0]


def _leveled(batches):
    """Sums of the blocks that a task has, as levels."""
    import pyarrow as pa

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "n"))):
            sums.setdefault(k, np.zeros(1 << BLOCK, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([levels(x).tobytes() for x in sums.values()], pa.binary())], ["block", "levels"])


def order(texts: DataFrame) -> np.ndarray:
    """The level of every cell of the word counts of texts; its size does not depend on them."""
    parts = texts.select("text").mapInArrow(_count, "block int, at binary, n binary").repartition("block").mapInArrow(_leveled, "block int, levels binary")
    out = np.zeros(1 << CELLS, np.uint8)
    for r in parts.collect():
        out[r["block"] << BLOCK : (r["block"] + 1) << BLOCK] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out


class Sets:
    """The word sets of many lines (an Arrow array): sizes, and of the kept lines hashes and tokens, from rare to frequent words.

    A token is a word's level and its hash: what orders words and what prefixes meet by.
    """

    def __init__(self, lines, level: np.ndarray | None, least: int):
        owner, kind, code, _ = word_codes(lines)
        k = max(1, len(code))
        token = code >> np.uint64(8)
        if level is not None:
            token |= level[(code >> np.uint64(64 - CELLS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
        by = np.lexsort((code, token))
        place = np.empty(len(code), np.int64)
        place[by] = np.arange(len(code))
        key = owner * k + place[kind]
        key.sort()
        key = key[np.diff(key, prepend=-1) != 0]
        owner, kind = key // k, by[key % k] if len(by) else key
        size = np.bincount(owner, minlength=len(lines))
        self.kept = np.flatnonzero(size >= least)
        self.size = size[self.kept]
        kind = kind[(size >= least)[owner]]
        self.hash, self.token = code[kind], token[kind]
        self.start = np.cumsum(self.size) - self.size

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name the set, whatever its words' order."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            return tuple(np.add.reduceat(mix(self.hash + np.uint64(s)), self.start).view(np.int64) for s in (1, GOLD))

    def parity(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits, each the parity of the words that hash to it."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bit = mix(self.hash) >> np.uint64(57)
        one = np.uint64(1) << (bit & np.uint64(63))
        return tuple(np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, one, np.uint64(0)), self.start).view(np.int64) for k in (0, 1))


def _split(texts):
    """The lines of an Arrow array of texts, the text of each and its place there."""
    import pyarrow.compute as pc

    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    off = lines.offsets.to_numpy()
    off = off - off[0]
    text = np.repeat(np.arange(len(texts)), np.diff(off))
    return lines.flatten(), text, np.arange(len(text)) - off[text]


def _lines(level, least, threshold):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, next_id = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in array_slices(texts):
                lines, text, line = _split(texts.slice(a, b - a))
                s = Sets(lines, np.frombuffer(level.value, np.uint8), least)
                text, line = text[s.kept], line[s.kept]
                p = prefix_length(s.size, threshold)
                at = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
                token, owner = s.token[np.repeat(s.start, p) + at], np.repeat(np.arange(len(p)), p)
                lev = token >> np.uint64(56)
                met = lev > 0  # a word counted once meets no other line; such words come first
                n_met = np.bincount(owner[met], minlength=len(p))
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_met)]).astype(np.int32)), pa.array(token[met].view(np.int64)))
                s1, s2 = s.sums()
                even, odd = s.parity()
                lid = part + next_id + np.arange(len(s.kept))
                next_id += len(s.kept)
                doc, th = (batch.column(c).slice(a, b - a).take(pa.array(text)) for c in ("doc_id", "th"))
                cols = {"doc_id": doc, "th": th, "line": pa.array(line.astype(np.int32)), "lid": pa.array(lid), "s1": pa.array(s1), "s2": pa.array(s2), "n": pa.array(s.size.astype(np.int32)), "bits": pa.array(even), "bits2": pa.array(odd), "lone": pa.array((p - n_met).astype(np.int32)), "prefix": prefix}
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _spot(th, line):
    return F.pmod(F.pmod(th, F.lit(2147483647)) * F.lit(1000003) + line.cast("long") * F.lit(8191), F.lit(BITS))


def _fetched(wanted, least):
    """The packed words of the lines that the filter lets through."""

    def run(batches):
        import pyarrow as pa

        bits = wanted.value
        for batch in batches:
            texts = batch.column("text")
            for a, b in array_slices(texts):
                lines, text, line = _split(texts.slice(a, b - a))
                doc, th = (batch.column(c).slice(a, b - a).to_numpy()[text] for c in ("doc_id", "th"))
                at = (np.mod(th, 2147483647) * 1000003 + line * 8191) % BITS
                hit = np.flatnonzero(bits[at >> 3] >> (at & 7) & 1)
                if not len(hit):
                    continue
                s = Sets(lines.take(pa.array(hit)), None, least)
                hit = hit[s.kept]
                ends = np.append(s.start, len(s.hash)) * 8
                packed = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(s.hash.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(th[hit]), pa.array(line[hit].astype(np.int32)), packed], ["doc_id", "th", "line", "words"])

    return run


def _pairs(first: np.ndarray, size: np.ndarray):
    """Places (x, y), x < y, of all pairs within runs of rows that start at first and have size rows, in bounded parts."""
    for many in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size * (size - 1) // 2) // PAIRS)) + 1):
        n, at = size[many], first[many]
        rest = np.concatenate([np.arange(k - 1, -1, -1) for k in n.tolist()]) if len(n) else np.zeros(0, np.int64)
        x = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        for some in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(rest) // PAIRS)) + 1):
            r = rest[some]
            left = np.repeat(x[some], r)
            yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r)


def _met(threshold):
    """Of postings by key: (lid, leader) of every line that may be similar to another one of its list.

    Such pairs make a graph; the leader is the least line of its component there.
    """

    def found(key, lid, n, pos, *bits):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        xs, ys = [], []
        for x, y in _pairs(first, size):
            nx, ny = n[x], n[y]
            need = np.ceil(threshold / (1 + threshold) * (nx + ny) - 1e-9)
            # at a pair's first shared token none before is shared
            ok = (np.minimum(nx, ny) >= threshold * np.maximum(nx, ny) - 1e-9) & (np.minimum(nx - pos[x], ny - pos[y]) >= need)
            x, y, room = x[ok], y[ok], (nx + ny - 2 * need)[ok]
            ok = sum(np.bitwise_count((b[x] ^ b[y]).view(np.uint64)) for b in bits) <= room
            xs.append(x[ok])
            ys.append(y[ok])
        x, y = np.concatenate([*xs, np.zeros(0, np.int64)]), np.concatenate([*ys, np.zeros(0, np.int64)])
        lead = lid.copy()
        while True:
            least = np.minimum(lead[x], lead[y])
            if (lead[x] == least).all() and (lead[y] == least).all():
                break
            np.minimum.at(lead, x, least)
            np.minimum.at(lead, y, least)
        some = np.unique(np.concatenate([x, y]))
        return lid[some], lead[some]

    def run(batches):
        import pyarrow as pa

        names, kept = ("key", "lid", "n", "pos", "bits", "bits2"), None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if kept is not None:
                cols = [np.concatenate(p) for p in zip(kept, cols)]
            done = cols[0][::-1] != cols[0][-1:]  # the last list may go on in the next batch
            end = len(done) - int(np.argmax(done)) if done.any() else 0
            kept = [c[end:] for c in cols]
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found(*[c[:end] for c in cols])], ["lid", "leader"])
        if kept is not None and len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found(*kept)], ["lid", "leader"])

    return run


def _similar(sets, others, threshold):
    """Of lines as word arrays, whether each pair (one of sets, one of others) is similar; without others the pairs of sets.

    Overlaps are a matrix product, summed over runs of words so that no matrix has more than GRID cells.
    """
    every = sets if others is None else [*sets, *others]
    n = np.array([len(w) for w in every])
    kinds, at, often = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    held = (often > 1)[at]  # words of one line only don't overlap
    column = (np.cumsum(often > 1) - 1)[at[held]]
    owner = np.repeat(np.arange(len(every)), n)[held]
    del kinds, at, held
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    step = max(64, GRID // len(every))
    rest = 0 if others is None else len(sets)
    over = np.zeros((len(sets), len(every) - rest), np.float64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, (start, start + step))
        m = np.zeros((len(every), step), np.float32)
        m[owner[i:j], column[i:j] - start] = 1
        over += m[: len(sets)] @ m[rest:].T
    return over >= threshold * (n[: len(sets), None] + n[None, rest:] - over) - 1e-9


def _linked(threshold):
    """Rows by key: lines of a group, or of two shares of one. (lid, links, near) of lines with links to lines there.

    A pair may meet in several groups; it counts in that of the least leader that both have.
    """

    def counted(leader, lines):
        # lines: side, lid, place, leaders, words
        cross = len({x[0] for x in lines}) > 1 or lines[0][0] >= 0
        links, near = dict.fromkeys((x[1] for x in lines), 0), set()

        def link(a, b):
            links[a[1]] += 1
            links[b[1]] += 1
            near.add(b[1] if a[2] < b[2] else a[1])

        earlier = [frozenset(k for k in x[3] if k < leader) for x in lines]
        left = [i for i, x in enumerate(lines) if x[0] <= 0]
        right = [i for i, x in enumerate(lines) if x[0] > 0] if cross else left
        if len(left) * len(right) <= 200:
            words = [frozenset(x[4].tolist()) for x in lines]
            for i in left:
                for j in right:
                    if cross or i < j:
                        both = len(words[i] & words[j])
                        if both >= threshold * (len(words[i]) + len(words[j]) - both) - 1e-9 and earlier[i].isdisjoint(earlier[j]):
                            link(lines[i], lines[j])
        else:
            ok = _similar([lines[i][4] for i in left], [lines[j][4] for j in right] if cross else None, threshold)
            if not cross:
                ok = np.triu(ok, 1)
            for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
                i, j = left[i], right[j]
                if earlier[i].isdisjoint(earlier[j]):
                    link(lines[i], lines[j])
        return [(k, n, k in near) for k, n in links.items() if n]

    def run(batches):
        import pyarrow as pa

        def told(out):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.bool_())], ["lid", "links", "near"])

        now, lead, lines, seen = None, None, [], set()
        for batch in batches:
            out = []
            for key, leader, side, lid, doc, th, line, leaders, words in zip(*(batch.column(c).to_pylist() for c in ("key", "leader", "side", "lid", "doc_id", "th", "line", "leaders", "words"))):
                if key != now:
                    if len(lines) > 1:
                        out += counted(lead, lines)
                    now, lead, lines, seen = key, leader, [], set()
                if lid not in seen:  # rows with equal doc_id and text are one document
                    seen.add(lid)
                    lines.append((side, lid, (doc, th, line), leaders, np.frombuffer(words, "<u8")))
            yield told(out)
        if len(lines) > 1:
            yield told(counted(lead, lines))

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


class _Join:
    def __init__(self, docs: DataFrame, threshold: float, least: int):
        spark = self.spark = docs.sparkSession
        ship(spark)
        self.threshold, self.least = threshold, least
        self.texts = _texts(docs).where("doc_id is not null and text is not null")
        level = spark.sparkContext.broadcast(order(self.texts).tobytes())
        schema = "doc_id long, th long, line int, lid long, s1 long, s2 long, n int, bits long, bits2 long, lone int, prefix array<long>"
        wide = keep(self.texts.mapInArrow(_lines(level, least, threshold), schema))
        first = F.min(F.struct("doc_id", "th", "line", "lid")).alias("f")
        sets = wide.groupBy("s1", "s2").agg(first, F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "bits", "bits2", "lone", "prefix")])
        self.sets = keep(sets.select("s1", "s2", "f.*", "copies", "n", "bits", "bits2", "lone", "prefix"))
        self.lines = keep(wide.select("doc_id", "th", "line", "s1", "s2"))
        drop(wide)

    def meetings(self) -> DataFrame:
        """(lid, leader), each once: two lines that are similar have a leader in common.

        Postings meet by token. A token of more than LIST postings is dealt in shares, each two of which meet.
        """
        c = F.col
        post = self.sets.where("size(prefix) > 0").select("lid", "n", "bits", "bits2", "lone", F.posexplode("prefix").alias("at", "token"))
        post = post.select("token", "lid", "n", (c("lone") + c("at")).alias("pos"), "bits", "bits2")
        often = F.shiftrightunsigned("token", 56) >= int(levels(np.array([LIST]))[0])  # fewer occurrences, fewer postings
        shares = keep(post.where(often).groupBy("token").agg(F.ceil(F.count("*") / LIST).alias("shares")).where("shares > 1"))
        big = post.where(often).join(shares, "token", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        own = F.pmod(F.xxhash64("lid"), c("shares"))
        big = big.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), c("shares") - 1)))
        key = F.when(c("shares") == 1, c("token")).otherwise(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
        cols = ["lid", "n", "pos", "bits", "bits2"]
        lists = post.where(~often).select(c("token").alias("key"), *cols).union(big.select(key.alias("key"), *cols))
        lists = lists.repartition("key").sortWithinPartitions("key")
        out = keep(lists.mapInArrow(_met(self.threshold), "lid long, leader long").distinct())
        drop(shares)
        return out

    def links(self) -> DataFrame:
        """Sets that are similar to others (s1, s2, lid, f: the first line): links, to how many; near, whether one of them has an earlier line."""
        c = F.col
        tidy(self.spark)  # what the tables before were made of
        first = self.meetings()
        tidy(self.spark)
        # leaders that meet a lesser one give way to it, alike for all their lines
        least = first.groupBy("lid").agg(F.min("leader").alias("least")).select(c("lid").alias("leader"), "least")
        met = keep(first.join(least, "leader").select("lid", c("least").alias("leader")).distinct())
        drop(first)
        mine = met.groupBy("lid").agg(F.collect_set("leader").alias("leaders"))
        named = keep(self.sets.select("lid", "doc_id", "th", "line", "s1", "s2", "n").join(mine, "lid"))
        size = named.select("n", F.explode("leaders").alias("leader")).groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / SIDE, F.sum("n") * 8 / SIDE_BYTES)).alias("sides"))
        sides = keep(size.where("sides > 1"))
        wanted = self.spark.sparkContext.broadcast(spots(named, _spot(c("th"), c("line")), BITS))
        got = self.texts.mapInArrow(_fetched(wanted, self.least), "doc_id long, th long, line int, words binary")
        at = ["doc_id", "th", "line"]
        rows = named.drop("s1", "s2", "n").join(got, at).withColumn("leader", F.explode("leaders")).join(sides, "leader", "left")
        share = F.pmod(F.xxhash64("lid"), F.coalesce("sides", F.lit(1)))
        rows = rows.withColumn("own", share).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("sides", F.lit(1)) - 1)))
        key = F.when(c("sides").isNull(), c("leader")).otherwise(F.xxhash64("leader", F.least("own", "other"), F.greatest("own", "other")))
        side = F.when(c("own") == c("other"), -1).when(c("own") < c("other"), 0).otherwise(1)
        rows = rows.select(key.alias("key"), "leader", side.alias("side"), "lid", *at, "leaders", "words")
        rows = rows.repartition("key").sortWithinPartitions("key", "leader")
        out = rows.mapInArrow(_linked(self.threshold), "lid long, links long, near boolean")
        out = out.groupBy("lid").agg(F.sum("links").alias("links"), F.bool_or("near").alias("near"))
        out = keep(out.join(named.select("s1", "s2", "lid", F.struct(*at).alias("f")), "lid").select("s1", "s2", "lid", "f", "links", "near"))
        drop(met, sides, named)
        return out


def _fates(docs: DataFrame, threshold: float, least: int) -> DataFrame:
    """doc_id, th, line, first (the lid of its set's first line), exact, near, links of every line that has a link or an equal."""
    j = _Join(docs, threshold, least)
    links = j.links()
    tidy(j.spark)
    at = ["doc_id", "th", "line"]
    more = j.sets.where("copies > 1").select("s1", "s2", "lid", F.struct(*at).alias("f"))
    own = links.select("lid", F.lit(True).alias("own"))
    more = more.join(own, "lid", "left").where("own is null").select("s1", "s2", "lid", "f", F.lit(0).cast("long").alias("links"), F.lit(False).alias("near"))
    sets = links.union(more)
    out = j.lines.select(*at, "s1", "s2").join(sets, ["s1", "s2"])
    out = out.select(*at, F.col("lid").alias("first"), (F.struct(*at) != F.col("f")).alias("exact"), "near", "links")
    out = keep(out.where("exact or links > 0"))
    drop(j.sets, j.lines, links)
    return out


def removals(docs: DataFrame, threshold: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, th, line, exact) of every line that goes; th: xxhash64 of its text; lines counted from 0; exact: an earlier line has the very same words.

    Null texts and rows without doc_id lose none. Rows with equal doc_id and text are one document here; other rows
    repeated under a doc_id are documents of their own, ordered by th.
    """
    return _fates(docs, threshold, least).where("exact or near").select("doc_id", "th", "line", "exact").distinct()


def report(docs: DataFrame, threshold: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """One row per row of docs:

    class_id: the least doc_id with the very same text (a null text: its own); n_lines; n_links: links that its distinct
    lines have to different lines anywhere; n_exact: lines that an earlier line equals; n_removed and removed: the lines that
    go, and their places. Rows with equal doc_id and text are one document and have equal results. Null and blank texts and
    rows without doc_id have no links and lose nothing; an empty table gives no rows.
    """
    gone = F.col("exact") | F.col("near")
    per = _fates(docs, threshold, least).groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_set(F.when(gone, F.col("line")))).alias("removed"),
        F.size(F.collect_set(F.when(F.col("exact"), F.col("line")))).cast("long").alias("n_exact"),
        F.collect_set(F.when(F.col("links") > 0, F.struct("first", "links"))).alias("met"),
    )
    per = per.withColumn("n_links", F.aggregate("met", F.lit(0).cast("long"), lambda n, x: n + x["links"])).drop("met")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    base = _texts(docs).select("doc_id", "th", n.cast("long").alias("n_lines"), F.when(F.col("text").isNotNull(), F.struct("th", F.xxhash64(F.lit(1), "text").alias("t2"))).alias("key"))
    classes = base.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    out = base.join(classes, "key", "left").join(per, ["doc_id", "th"], "left")
    none, zero = F.array().cast("array<int>"), F.lit(0).cast("long")
    removed = F.coalesce("removed", none)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", own.alias("class_id"), "n_lines", F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_exact", zero).alias("n_exact"), F.size(removed).cast("long").alias("n_removed"), F.concat_ws(",", removed.cast("array<string>")).alias("removed"))


def dedup(docs: DataFrame, threshold: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """docs with those lines taken out of text; a text that loses its last line with a word goes. n_chars, where docs has it, follows.

    Of rows with equal doc_id and text one stays (the lines of the others equal its own). Null texts, texts without a word
    and rows without doc_id stay as they are. Other columns are passed on, whatever their names.
    """
    own = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(own))])
    c = {x: F.col(f"c{i}") for i, x in enumerate(own)}
    text, doc = c["text"].cast("string"), c["doc_id"].cast("long")
    rows = rows.withColumn("id", doc).withColumn("th", F.xxhash64(text))
    again = rows.where("id is not null").where(text.isNotNull()).groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1")
    again = keep(again.select("id", "th"))
    if not again.isEmpty():
        some = rows.join(again, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
        rows = rows.join(again, ["id", "th"], "left_anti").unionByName(some)
    cut = removals(docs.select("doc_id", "text"), threshold, least).groupBy("doc_id", "th").agg(F.collect_set("line").alias("cut"))
    cut = keep(cut.withColumnRenamed("doc_id", "id"))
    kept = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(~F.array_contains("cut", i), x)), lambda x: x.isNotNull())
    rows = rows.join(cut, ["id", "th"], "left").withColumn("new", F.when(F.col("cut").isNotNull(), F.array_join(kept, "\n")))
    rows = rows.where(r"new is null or new rlike '[^\\x20\\x09-\\x0D]'")
    new = {"text": F.coalesce("new", text), "n_chars": F.when(F.col("new").isNull(), c.get("n_chars", text)).otherwise(F.length("new"))}
    return rows.select(*[new.get(x, c[x]).alias(x) for x in own])

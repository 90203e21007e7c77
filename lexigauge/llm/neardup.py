"""Near-duplicate documents by ProbMinHash.

A text is its five-word shingles, weighted by how often each occurs. Every element is a Poisson process whose rate is
its weight; an arrival falls on a random register, and each register keeps the element that came first. Elements stop
when their next arrival is later than every register's. Two signatures agree in a register with the probability
Jaccard similarity of the weights. Bands of registers make buckets. A bucket is named by its least text (the leader), and
texts of one leader are compared: all registers estimate first, then the shingles verify. A pair that is in one class
already isn't compared. Large groups are dealt in shares, each with the leader; then texts outside a group's main class
meet the whole group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, array_slices, components, drop, keep, ship, spots, tidy, word_codes
from .common import mix as _mix

WIDTH, SIMILARITY = 5, 0.8
#: 25 bands of 5: a pair at 0.8 meets in none with probability 5e-5.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Five standard deviations of the estimate below the threshold: pairs under it aren't verified (1 in 3 million at 0.8).
ESTIMATE = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Texts of a group that are compared in one place, and bytes of their packed shingles.
SIDE, SIDE_BYTES = 512, 32 << 20
#: Bits of the filter for the texts to fetch for comparison; a chance hit costs time only.
BITS = 1 << 26


def _words(texts):
    """Of an Arrow array of texts: the text and the hash of every word."""
    owner, kind, code, _ = word_codes(texts)
    return owner, code[kind]


def names(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits that name each text's sequence of words, and whether it has any."""
    count = np.bincount(owner, minlength=n)
    some = count > 0
    start = (np.cumsum(count) - count)[some]
    place = (np.arange(len(owner)) - np.repeat(start, count[some])).astype(np.uint64)
    out = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    with np.errstate(over="ignore"):
        for o, seed in zip(out, (1, GOLD)):
            if len(start):
                o[some] = np.add.reduceat(_mix(h + _mix(place + np.uint64(seed))), start).view(np.int64)
    return out[0], out[1], some


def shingles(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the shingles of several texts' words, by text and hash. A text of one to four words is one shingle."""
    m = max(0, len(h) - WIDTH + 1)
    at = np.flatnonzero(owner[:m] == owner[WIDTH - 1 :]) if m else np.zeros(0, np.int64)
    s = np.full(len(at), 7, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            s = _mix(s * np.uint64(GOLD) + h[at + k])
    who = owner[at]
    count = np.bincount(owner) if len(owner) else np.zeros(0, np.int64)
    few = (count > 0) & (count < WIDTH)
    if few.any():
        start = (np.cumsum(count) - count)[few]
        whole = np.full(len(start), 7, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WIDTH - 1):
                has = count[few] > k
                whole[has] = _mix(whole[has] * np.uint64(GOLD) + h[start[has] + k])
            whole = _mix(whole + count[few].astype(np.uint64))
        s, who = np.concatenate([s, whole]), np.concatenate([who, np.flatnonzero(few)])
    o = np.lexsort((s, who))
    s, who = s[o], who[o]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (who[1:] != who[:-1])
    first = np.flatnonzero(new)
    return who[first], s[first], np.diff(np.append(first, len(s)))


def signatures(who: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n by REGISTERS element hashes; rows without elements stay 0."""
    best = np.full(n * REGISTERS, np.inf)
    sig = np.zeros(n * REGISTERS, np.uint64)
    live, time, k = np.arange(len(h)), np.zeros(len(h)), 0
    while len(live):
        k += 1
        with np.errstate(over="ignore"):
            u = _mix(h[live] + np.uint64(GOLD) * np.uint64(2 * k))
            reg = (_mix(u + np.uint64(GOLD)) >> np.uint64(11)) % np.uint64(REGISTERS)
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        cell = who[live] * REGISTERS + reg.astype(np.int64)
        np.minimum.at(best, cell, time)
        won = best[cell] == time
        sig[cell[won]] = h[live[won]]
        last = best.reshape(n, REGISTERS).max(1)
        stay = time < last[who[live]]
        live, time = live[stay], time[stay]
    return sig.reshape(n, REGISTERS)


def similarity(x: np.ndarray, xw: np.ndarray, y: np.ndarray, yw: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets with sorted elements."""
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if (xw == xw[0]).all() and (yw == yw[0]).all():
        return len(both) / (len(x) + len(y) - len(both))  # of equal weights: the plain one
    a, b = xw / xw.sum(), yw / yw.sum()
    only_x, only_y = 1 - a[i].sum(), 1 - b[j].sum()
    a, b = a[i], b[j]
    ratio = a / b
    o = np.argsort(ratio, kind="stable")
    a, b, ratio = a[o], b[o], ratio[o]
    above = np.concatenate([np.cumsum(a[::-1])[::-1], [0]])
    below = np.concatenate([[0], np.cumsum(b)])
    k = np.searchsorted(ratio, ratio, "left")
    return float((1 / ((above[k] + only_x) / a + (below[k] + only_y) / b)).sum())


def _sign(batches):
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("text")
        for a, b in array_slices(texts):
            owner, h = _words(texts.slice(a, b - a))
            sig = signatures(*shingles(owner, h), b - a)
            bands = np.zeros((b - a, BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(BANDS):
                    x = np.full(b - a, k + 1, np.uint64)
                    for r in range(ROWS):
                        x = _mix(x * np.uint64(GOLD) + sig[:, k * ROWS + r])
                    bands[:, k] = x
            s1, s2, some = names(owner, h, b - a)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))
            ids = [batch.column(c).slice(a, b - a) for c in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(s1, mask=~some), pa.array(s2, mask=~some), keys], ["doc_id", "th", "s1", "s2", "bands"])


def _packed(wanted):
    """Names, registers and shingles of the rows that the filter lets through."""

    def run(batches):
        import pyarrow as pa

        bits = wanted.value
        for batch in batches:
            at = np.mod(batch.column("th").to_numpy(), BITS)
            texts = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool))).column("text")
            for a, b in array_slices(texts):
                owner, h = _words(texts.slice(a, b - a))
                s1, s2, _ = names(owner, h, b - a)
                who, h, w = shingles(owner, h)
                # upper halves: equal registers stay equal, and the order of shingles stays; chance equals within a pair of
                # texts are under 1e-4 shingles on average
                sig = (signatures(who, h, w, b - a) >> np.uint64(32)).astype("<u4")
                cut = np.searchsorted(who, np.arange(b - a + 1))
                h, w = (h >> np.uint64(32)).astype("<u4"), w.astype("<u4")
                out = [(b"" if (w[i:j] == 1).all() else b"w" + w[i:j].tobytes()) + h[i:j].tobytes() for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(out, pa.binary())], ["s1", "s2", "sig", "set"])

    return run


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    weighted = len(raw) % 4  # a leading byte tells that weights come first
    v = np.frombuffer(raw, "<u4", offset=weighted)
    w, h = (v[: len(v) // 2], v[len(v) // 2 :]) if weighted else (np.ones(len(v)), v)
    kinds, inverse = np.unique(h, return_inverse=True)
    return kinds, np.bincount(inverse, weights=w, minlength=len(kinds))


class Group:
    """The packed sets of one place's texts with their elements numbered, so that one text meets many at a time."""

    def __init__(self, packed: list[bytes]):
        sets = [_unpack(x) for x in packed]
        self.size = np.array([len(x) for x, _ in sets])
        self.start = np.cumsum(self.size) - self.size
        kinds, number = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)
        self.number, self.weight = number.astype(np.int32), np.concatenate([w / w.sum() for _, w in sets])
        self.flat = np.array([bool((w == w[0]).all()) for _, w in sets])
        self.mark = np.zeros(len(kinds))

    def bounds(self, i: int, others: list[int]) -> tuple[list[float], list[bool]]:
        """Of each other text: its similarity to text i, True; or what that can't exceed, False, where weights differ."""
        own = self.number[self.start[i] : self.start[i] + self.size[i]]
        o = np.array(others)
        at = np.concatenate([np.arange(self.start[j], self.start[j] + self.size[j]) for j in others])
        cut = np.cumsum(self.size[o]) - self.size[o]
        met, theirs = self.number[at], self.weight[at]
        self.mark[own] = 1
        hit = self.mark[met]
        both, heard = np.add.reduceat(hit, cut), np.add.reduceat(hit * theirs, cut)
        self.mark[own] = self.weight[self.start[i] : self.start[i] + self.size[i]]
        said = np.add.reduceat(self.mark[met], cut)
        self.mark[own] = 0
        exact = self.flat[o] & self.flat[i]
        # an element of both adds at most the lesser of its two shares
        most = np.where(exact, both / (self.size[i] + self.size[o] - both), np.minimum(said, heard) + 1e-9)
        return most.tolist(), exact.tolist()


def _joined(threshold):
    """Rows by key: texts of a group with the class they are in. Edges (a, b) that join those that are similar, a tree a class."""

    def joined(rows):
        sig = np.frombuffer(b"".join(r[2] for r in rows), "<u4").reshape(-1, REGISTERS)
        up, sets = list(range(len(rows))), {}
        first: dict = {}
        for i, r in enumerate(rows):
            up[i] = first.setdefault(r[1], i)

        def top(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def unpacked(i):
            if len(sets) > 256 and i not in sets:
                sets.clear()
            return sets[i] if i in sets else sets.setdefault(i, _unpack(rows[i][3]))

        out, group = [], None
        for i in range(len(rows) - 1):
            share = (sig[i + 1 :] == sig[i]).mean(1)
            a = top(i)
            near = [j for j in (np.flatnonzero(share >= ESTIMATE) + i + 1).tolist() if top(j) != a]
            if not near:
                continue
            group = group or Group([r[3] for r in rows])
            for j, most, exact in zip(near, *group.bounds(i, near)):
                a, b = top(i), top(j)
                if a != b and most >= threshold and (exact or similarity(*unpacked(i), *unpacked(j)) >= threshold):
                    up[b] = a
                    out.append((rows[i][0], rows[j][0]))
        return out

    def run(batches):
        import pyarrow as pa

        def told(out):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        now, rows = None, []
        for batch in batches:
            out = []
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "lid", "root", "sig", "set"))):
                if key != now:
                    out += joined(rows) if len(rows) > 1 else []
                    now, rows = key, []
                rows.append(row)
            yield told(out)
        if len(rows) > 1:
            yield told(joined(rows))

    return run


def _edges(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges within each key of rows (key, lid, root)."""
    rows = rows.distinct().join(sets.select("lid", "sig", "set"), "lid").select("key", "lid", "root", "sig", "set")
    return keep(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_joined(threshold), "a long, b long"))


def _rest(meet: DataFrame, sides: DataFrame, root: DataFrame) -> DataFrame:
    """(key, lid, root) of the comparisons left in large groups: who isn't in the group's main class meets all of the group."""
    c = F.col
    of = meet.join(sides, "leader").join(root.select(c("node").alias("lid"), "root"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    of = keep(of)
    per = of.groupBy("leader", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    per = per.groupBy("leader").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("most"))
    open_ = keep(per.where("kinds > 1").select("leader", "main", _sides(c("n") - c("most"), c("bytes")).alias("odd"), _sides(c("n"), c("bytes")).alias("all")))
    if open_.isEmpty():
        return None
    x = of.select("leader", "lid", "root").join(open_, "leader").withColumn("main", c("root") == c("main"))
    h = F.xxhash64("lid", F.lit(2))
    own = F.when(c("main"), c("odd") + F.pmod(h, c("all"))).otherwise(F.pmod(h, c("odd")))
    last = F.when(c("main"), c("odd") - 1).otherwise(c("odd") + c("all") - 1)
    x = x.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return x.select(F.xxhash64("leader", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "lid", "root")


def _sides(n, size):
    return F.ceil(F.greatest(n / SIDE, size / SIDE_BYTES))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, th, first (doc_id, th of the least row of the class) and copy_of, of every row of docs; both null where it has no class."""
    spark = docs.sparkSession
    ship(spark)
    c = F.col
    text = c("text").cast("string")
    texts = docs.select(c("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed = keep(texts.mapInArrow(_sign, "doc_id long, th long, s1 long, s2 long, bands array<long>"))
    real = signed.where("s1 is not null and doc_id is not null")
    reps = real.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "th")).alias("f"), F.first("bands").alias("bands"))
    reps = keep(reps.select("s1", "s2", "f", "bands").withColumn("lid", F.monotonically_increasing_id()))
    tidy(spark)
    member = reps.select("lid", F.explode("bands").alias("bucket"))
    lead = member.groupBy("bucket").agg(F.min("lid").alias("leader"), F.max("lid").alias("hi")).where("leader < hi").select("bucket", "leader")
    meet = keep(member.join(lead, "bucket").select("lid", "leader").distinct())
    tidy(spark)
    cand = keep(meet.select("lid").distinct().join(reps.select("lid", "s1", "s2", c("f.th").alias("th")), "lid"))
    wanted = spark.sparkContext.broadcast(spots(cand, F.pmod("th", F.lit(BITS)), BITS))
    sets = texts.where("doc_id is not null").mapInArrow(_packed(wanted), "s1 long, s2 long, sig binary, set binary")
    sets = keep(sets.join(cand.select("s1", "s2", "lid"), ["s1", "s2"]).groupBy("lid").agg(F.first("sig").alias("sig"), F.first("set").alias("set")))
    drop(cand)
    meet_all, meet = meet, keep(meet.join(sets.select("lid", F.length("set").alias("bytes")), "lid"))
    drop(meet_all)
    sides = keep(meet.groupBy("leader").agg(_sides(F.count("*"), F.sum("bytes")).alias("sides")).where("sides > 1"))
    rows = meet.join(sides, "leader", "left").withColumn("sides", F.coalesce("sides", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("lid"), c("sides")))
    every = F.sequence(F.lit(0).cast("long"), c("sides") - 1)  # the leader is in all shares
    rows = rows.withColumn("own", F.explode(F.when(c("lid") == c("leader"), every).otherwise(own)))
    rows = rows.select(F.when(c("sides") == 1, c("leader")).otherwise(F.xxhash64("leader", "own")).alias("key"), "lid", c("lid").alias("root"))
    found = _edges(rows, sets, threshold)
    tidy(spark)
    root = keep(components(found))
    drop(found)
    rest = _rest(meet, sides, root)
    if rest is not None:
        found = _edges(rest, sets, threshold)
        old = root
        root = keep(components(found.union(old.select("root", "node"))))
        drop(found, old)
    drop(meet, sets, sides)
    tidy(spark)
    named = reps.select("s1", "s2", "lid", "f").join(root.select(c("node").alias("lid"), "root"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    least = named.groupBy("root").agg(F.min("f").alias("first"))
    named = keep(named.join(least, "root").select("s1", "s2", "first", c("f.doc_id").alias("copy_of")))
    out = keep(signed.select("doc_id", "th", F.when(c("doc_id").isNotNull(), c("s1")).alias("s1"), "s2").join(named, ["s1", "s2"], "left").select("doc_id", "th", "first", "copy_of"))
    drop(signed, reps, root, named)
    tidy(spark)
    return out


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its class), copy_of (the least doc_id with the same words).

    Texts without a word (null, empty, blank) and rows without doc_id are classes of their own. Classes are the
    connected components of verified links; rows repeated under a doc_id are told apart by their words. An empty table gives none.
    """
    return _classes(docs, threshold).select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def dedup(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of least doc_id, then xxhash64 of the text; of rows equal in both, any one.

    Texts without a word and rows without doc_id stay, all of them. Other columns are passed on, whatever their names.
    """
    own = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(own))])
    rows = rows.withColumn("id", F.col(f"c{own.index('doc_id')}").cast("long")).withColumn("th", F.xxhash64(F.col(f"c{own.index('text')}").cast("string")))
    c = _classes(docs.select("doc_id", "text"), threshold).where("first is not null")
    lost = keep(c.where("first <> struct(doc_id, th)").select(F.col("doc_id").alias("id"), "th").distinct())
    again = keep(c.groupBy(F.col("doc_id").alias("id"), "th").agg(F.count("*").alias("n")).where("n > 1").select("id", "th"))
    rows = rows.join(lost, ["id", "th"], "left_anti")
    if not again.isEmpty():
        once = rows.join(again, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
        rows = rows.join(again, ["id", "th"], "left_anti").unionByName(once)
    return rows.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(own)])

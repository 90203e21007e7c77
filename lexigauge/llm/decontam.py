"""Benchmark decontamination by spaced seeds.

A mask fixes which of a few neighbouring words are hashed; the others may differ. Hashes of training positions meet
those of the benchmark, each hit names a diagonal (training position minus benchmark position), and the words along
the diagonal are compared one by one: the longest run that is at least 80 % equal must be long enough.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, keep, quoted, ship, slices

#: Five words each; a 0 is a position that is ignored.
MASKS = ("11111", "1101101", "1011011", "11001011", "10110011")
#: A leak: a run of at least so many words (or the whole item, if shorter), of which SIMILARITY are equal in place.
MIN_WORDS, SIMILARITY = 13, 0.8
#: Words of benchmark text up to which it is sent to every executor (about 100 bytes a word); beyond, hashes are joined.
BROADCAST_WORDS = 400_000

WORD = re.compile(r"\w+")


def words(text: bytes) -> list[str]:
    return WORD.findall(text.decode().lower())


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def seeds(ids: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash at each position of uint64 word values; shorter than the mask: none."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    for p, c in enumerate(mask):
        if c == "1":
            out = _mix(out + ids[p : p + n])
    return out


def best_run(same: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(first, past the last) of the longest run of which that share is equal; ties to more equal words, then the first. (0, 0): none."""
    equal = np.concatenate([[0], np.cumsum(same)])
    total = equal - similarity * np.arange(len(equal))
    low = np.minimum.accumulate(total)
    # of every end the first start whose sum is no higher; the tolerance is for sums of fractions
    start = np.searchsorted(-low, -(total + 1e-9), "left")
    size = np.arange(len(equal)) - start
    longest = np.flatnonzero(size == size.max())
    end = int(longest[np.argmax((equal - equal[start])[longest])])
    return int(start[end]), end


def verify(doc: np.ndarray, item: np.ndarray, diagonal: int, min_words: int, similarity: float):
    """The overlap on a diagonal: (words, equal words, first in document, first in item), or None."""
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if b <= a:
        return None
    same = doc[a + diagonal : b + diagonal] == item[a:b]
    whole = len(item) < min_words or len(item) * similarity < min_words
    need = int(np.ceil(similarity * len(item))) if whole else min_words
    if same.sum() < similarity * need - 1e-9:
        return None
    s, e = best_run(same, similarity)
    if e - s < need:
        return None
    return e - s, int(same[s:e].sum()), a + s + diagonal, a + s


class Index:
    """The benchmark in memory: word ids, items as id arrays, and sorted seeds with their item and position."""

    def __init__(self, rows):
        self.vocab: dict[str, int] = {}
        self.items, self.ids = [], []
        for item_id, text in rows:
            w = words((text or "").encode())
            self.items.append(np.fromiter((self.vocab.setdefault(x, len(self.vocab)) for x in w), np.int64, len(w)))
            self.ids.append(item_id)
        self.seeds = []
        for m, mask in enumerate(MASKS):
            h = [seeds(_mix(x.astype(np.uint64)), mask, m) for x in self.items]
            key = np.concatenate([*h, np.zeros(0, np.uint64)])
            item = np.repeat(np.arange(len(h)), [len(x) for x in h])
            at = np.concatenate([*(np.arange(len(x)) for x in h), np.zeros(0, np.int64)]).astype(np.int64)
            o = np.argsort(key, kind="stable")
            self.seeds.append((key[o], item[o], at[o]))

    def hits(self, ids: np.ndarray):
        """Distinct (position, item, diagonal origin) where a seed of any mask meets; ids: -1 for words the benchmark lacks."""
        mixed = _mix(ids.astype(np.uint64))
        out = []
        for m, (mask, (key, item, at)) in enumerate(zip(MASKS, self.seeds)):
            n = len(ids) - len(mask) + 1
            if n <= 0 or not len(key):
                continue
            known = np.ones(n, bool)
            for p, c in enumerate(mask):
                if c == "1":
                    known &= ids[p : p + n] >= 0
            pos = np.flatnonzero(known)
            if not len(pos):
                continue
            h = np.full(len(pos), m + 1, np.uint64)
            for p, c in enumerate(mask):
                if c == "1":
                    h = _mix(h + mixed[pos + p])
            lo, hi = np.searchsorted(key, h, "left"), np.searchsorted(key, h, "right")
            n_of = hi - lo
            if not n_of.any():
                continue
            who = np.repeat(np.arange(len(pos)), n_of)
            k = np.arange(len(who)) - np.repeat(np.cumsum(n_of) - n_of, n_of) + np.repeat(lo, n_of)
            out.append(np.stack([pos[who], item[k], pos[who] - at[k]], 1))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


SCHEMA = "doc_id long, item_id long, n_words long, n_equal long, doc_start long, item_start long"


def _scan(index, min_words, similarity):
    def run(batches):
        import pyarrow as pa

        ix: Index = index.value
        get = ix.vocab.get
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), column(batch, "text")
            out = []
            for a, b in slices(texts):
                split = [words(t) for t in texts[a:b]]
                size = np.array([len(w) for w in split])
                # a gap of unknown words keeps seeds from crossing texts
                gap = max(map(len, MASKS))
                flat = np.concatenate([x for w in split for x in (np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)), np.full(gap, -1))])
                start = np.concatenate([[0], np.cumsum(size + gap)])
                h = ix.hits(flat)
                if not len(h):
                    continue
                doc = np.searchsorted(start, h[:, 0], "right") - 1
                for d, i, diag in np.unique(np.stack([doc, h[:, 1], h[:, 2] - start[doc]], 1), axis=0).tolist():
                    if found := verify(flat[start[d] : start[d] + size[d]], ix.items[i], diag, min_words, similarity):
                        out.append((docs[a + d], ix.ids[i], *found))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_words", "n_equal", "doc_start", "item_start"])

    return run


def _emit(kind: str):
    """(hash, row, position) of every seed of every text, for the joined form."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows = batch.column("row").to_pylist()
            for row, text in zip(rows, column(batch, "text")):
                w = words(text)
                v = np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64)
                h = [seeds(v, m, k) for k, m in enumerate(MASKS)]
                key = np.concatenate(h).view(np.int64)
                at = np.concatenate([np.arange(len(x)) for x in h]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), row, np.int64)), pa.array(at)], ["h", f"{kind}_row", f"{kind}_at"])

    return run


def _checked(min_words, similarity):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for doc_id, item_id, text, item, diags in zip(b.column("doc_id").to_pylist(), b.column("item_id").to_pylist(), column(b, "text"), column(b, "item"), b.column("diags").to_pylist()):
                vocab: dict[str, int] = {}
                x = np.array([vocab.setdefault(w, len(vocab)) for w in words(text)], np.int64)
                y = np.array([vocab.setdefault(w, len(vocab)) for w in words(item)], np.int64)
                out += [(doc_id, item_id, *f) for d in diags if (f := verify(x, y, d, min_words, similarity))]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_words", "n_equal", "doc_start", "item_start"])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Leaks of benchmark items: one row per doc_id and item_id with its longest overlap.

    n_words and n_equal (words of the run, and those equal in place), doc_start and item_start (word positions).
    Words: runs of letters, digits and underscores, lower-cased. Nulls are empty texts. Items of fewer than five words
    have no seed and never match. Of equal overlaps the first in the document, then in the item, stays. Rows repeated
    under one doc_id give one row; an empty table on either side gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bench = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    n = bench.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    if n <= 2 * broadcast_words or (n <= 12 * broadcast_words and bench.agg(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0] <= broadcast_words):
        index = spark.sparkContext.broadcast(Index(bench.collect()))
        found = docs.where("text is not null").mapInArrow(_scan(index, min_words, similarity), SCHEMA)
    else:
        found = _joined(docs, bench, min_words, similarity)
    best = F.max_by(F.struct("n_words", "n_equal", "doc_start", "item_start"), F.struct("n_equal", "n_words", -F.col("doc_start"), -F.col("item_start"))).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def _joined(docs, bench, min_words, similarity):
    """For a benchmark of any size: seeds of both sides meet in a shuffle join, then texts come back to the hits."""
    d = docs.where("text is not null").withColumn("row", F.xxhash64("doc_id", "text"))
    b = bench.withColumn("row", F.xxhash64("item_id", "text"))
    left = d.select("row", "text").mapInArrow(_emit("doc"), "h long, doc_row long, doc_at long")
    right = b.select("row", "text").mapInArrow(_emit("item"), "h long, item_row long, item_at long")
    hits = left.join(right, "h").select("doc_row", "item_row", (F.col("doc_at") - F.col("item_at")).alias("diag")).distinct()
    hits = hits.groupBy("doc_row", "item_row").agg(F.collect_list("diag").alias("diags"))  # at most a diagonal per word of the two texts
    pairs = hits.join(b.select(F.col("row").alias("item_row"), "item_id", F.col("text").alias("item")).dropDuplicates(["item_row"]), "item_row")
    pairs = pairs.join(d.select(F.col("row").alias("doc_row"), "doc_id", "text").dropDuplicates(["doc_row"]), "doc_row")
    return pairs.select("doc_id", "item_id", "text", "item", "diags").mapInArrow(_checked(min_words, similarity), SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs without those that hold a leak, columns as they came; a row without doc_id stays, rows that share a doc_id go together."""
    bad = keep(overlaps(docs, benchmark, **kw).select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])

"""Substring joins without a cross join: which texts hold which needles, and in which paragraph a row belongs.

A needle's rarest gram among all texts names the few texts that may hold it; those are then searched for the whole needle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.operators.cuts import cut

#: Grams have as many characters as the widest of these that the needle has.
WIDTHS = (1, 2, 3, 4, 12)
#: Grams wanted, each 16 bytes, up to which they are broadcast; beyond, the joins shuffle. Shares of a gram's texts then.
BROADCAST_GRAMS, SHARES = 200_000, 16
PROBE = 60
#: first_holding: bytes of a needle's start that are looked for at every place, the filter's bits (16 MB), bytes of text a step.
ANCHORS, FILTER_BITS, PIECE = (1, 2, 3, 4, 8, 16, 32), 1 << 27, 1 << 20
SHIFT, MASK, BASE = np.uint64(64 - 27), np.uint64((1 << 27) - 1), 0x5851F42D4C957F2D
#: Runs of bytes that a task holds before it gives them on.
MOST_RUNS = 200_000


def _grams(text: Column, width: int) -> Column:
    """The different runs of so many characters, overlapping ones too."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))


def holding(needles: DataFrame, texts: DataFrame, needle: str = "needle", key: str = "key", text: str = "text") -> DataFrame:
    """(needle, key) of all texts that hold a needle, each once. Nulls match nothing; an empty needle is in every text.

    Needles count once however often they come, and keys must be unique. Texts go through no shuffle but that of their grams
    which some needle has; candidates fetch their text by key.
    """
    spark = needles.sparkSession
    want = needles.select(F.col(needle).alias("needle")).where("needle is not null").distinct()
    held = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    n = F.length("needle")
    width = F.lit(None).cast("int")
    for w in sorted(WIDTHS, reverse=True):
        width = F.coalesce(width, F.when(n >= w, w))
    want = want.withColumn("width", width)
    widths = sorted(r[0] for r in want.where("width is not null").select("width").distinct().collect())  # five at most
    none = spark.createDataFrame([], needles.select(F.col(needle).alias("needle")).schema)
    every = want.where("needle = ''").select("needle")
    found = every.crossJoin(held.select("key")) if every.limit(1).count() else none.crossJoin(held.select("key").limit(0))  # one row
    if not widths:
        return found.select("needle", "key")

    def of_width(column, w):
        return F.transform(_grams(column, w), lambda g: F.struct(F.lit(w).alias("width"), g.alias("gram")))

    def exploded(df, column, has_width):
        rows = F.concat(*[of_width(column, w) for w in widths])
        if has_width:
            rows = F.filter(rows, lambda r: r["width"] == F.col("width"))
        return df.withColumn("g", F.explode(rows)).drop("width").select("*", F.col("g.width").alias("width"), F.xxhash64("g.gram").alias("gram")).drop("g")

    own = exploded(want.where("width is not null"), F.col("needle"), True)
    asked = own.select("width", "gram").distinct()
    small = asked.count() <= BROADCAST_GRAMS
    ways = F.broadcast if small else (lambda df: df)
    grams = exploded(held, F.col("text"), False).select("key", "width", "gram").join(ways(asked), ["width", "gram"], "left_semi")
    often = grams.groupBy("width", "gram").agg(F.count("*").alias("n"))
    rarest = own.join(often, ["width", "gram"], "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "width", "gram")).alias("r")).where("r.n > 0").select("needle", "r.width", "r.gram")
    if small:
        near = grams.join(F.broadcast(rarest), ["width", "gram"])
    else:  # texts of one gram go to several tasks
        salted = rarest.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        near = grams.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(SHARES)).cast("int")).join(salted, ["width", "gram", "share"])
    near = near.select("needle", "key").join(held, "key").where(F.col("text").contains(F.col("needle")))
    return near.select("needle", "key").unionByName(found.select("needle", "key"))


def _hashed(data, width, at):
    """64-bit hashes of the `width` bytes from each place on; equal runs share one."""
    sums, inverse = data
    return _mixed((sums[at + width] - sums[at]) * inverse[at], width)


def _mixed(h, width):
    h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(width)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Places:
    """Running sums of byte times power, so that any run's hash is one difference."""

    def __init__(self, most: int):
        up, down = np.full(most + 1, BASE, np.uint64), np.full(most + 1, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def of(self, raw):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], dtype=np.uint64, out=sums[1:])
        return sums, self.down


def _anchor(n: int) -> int:
    return max(w for w in ANCHORS if w <= n)


def _marks(batches):
    """Of each needle its length in bytes and the spots of its anchor (the first bytes) and of its whole in the filter."""
    import pyarrow as pa

    for batch in batches:
        needles = [x.as_py().encode() for x in batch.column(0)]
        places = _Places(max(map(len, needles), default=0))
        rows = []
        with np.errstate(over="ignore"):
            for x in needles:
                data = places.of(np.frombuffer(x, np.uint8))
                start = np.zeros(1, np.int64)
                rows += [(len(x), int(_hashed(data, _anchor(len(x)), start)[0] >> SHIFT)), (len(x), int(_hashed(data, len(x), start)[0] & MASK))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["size", "spot"])


def _runs(filter_, lengths):
    """The runs of bytes that may be needles, each once a batch, with the least order of its texts."""

    def run(batches):
        import pyarrow as pa

        bits = filter_.value
        has = lambda h: (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0
        groups = {w: [n for n in lengths if _anchor(n) == w] for w in ANCHORS}
        places = _Places(PIECE + lengths[-1])

        def given(batch, found):
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), batch.column(0).take(pa.array(list(found.values()), pa.int64()))], ["run", "first"])

        for batch in batches:
            firsts = [tuple(x.values()) if isinstance(x, dict) else (x,) for x in batch.column(0).to_pylist()]
            found: dict = {}
            order = sorted(range(batch.num_rows), key=lambda i: [(v is not None, v) for v in firsts[i]])  # so a run's first text counts
            texts = [batch.column(1)[i].as_py().encode() for i in order]
            starts = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
            raw = np.frombuffer(b"\xff".join(texts), np.uint8)  # a byte that no needle has
            for a in range(0, len(raw), PIECE):
                piece = raw[a : a + PIECE + lengths[-1] - 1]
                own, cells = min(PIECE, len(raw) - a), piece.tobytes()
                with np.errstate(over="ignore"):
                    data = places.of(piece)
                    for w, sizes in groups.items():
                        if not sizes or len(piece) < w:
                            continue
                        at = np.arange(min(own, len(piece) - w + 1))
                        at = at[has(_hashed(data, w, at) >> SHIFT)]
                        for n in sizes:
                            fit = at[at + n <= len(piece)]
                            fit = fit[has(_hashed(data, n, fit) & MASK)]
                            for x, i in zip(fit.tolist(), np.searchsorted(starts, fit + a, "right").tolist()):
                                found.setdefault(cells[x : x + n], order[i - 1])
                if len(found) >= MOST_RUNS:
                    yield given(batch, found)
                    found = {}
            yield given(batch, found)

    return run


def first_holding(needles: DataFrame, texts: DataFrame, needle: str = "needle", first: str = "first", text: str = "text") -> DataFrame:
    """(needle, first) of every needle that a text holds, with the least `first` of those texts. Nulls match nothing.

    Needles mark a filter of fixed size, by their first bytes and by their whole. Each text is read once, gives the
    runs that the filter lets through, and those meet the needles as strings, so what the filter lets through
    wrongly goes. Of a run only its least text is shuffled, not every pair; texts are not shuffled at all.
    """
    spark = needles.sparkSession
    want = needles.select(F.col(needle).alias("needle")).where("needle is not null").distinct()
    held = texts.select(F.col(first).alias("first"), F.col(text).alias("text")).where("text is not null")
    every = want.where("needle = ''").crossJoin(held.agg(F.min("first").alias("first"))).where("first is not null")  # one row
    marks = cut(want.where("needle <> ''").select("needle").mapInArrow(_marks, "size long, spot long"))
    lengths = sorted(r[0] for r in marks.select("size").distinct().collect())  # a needle's lengths, not needles
    if not lengths:
        return every
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    x = marks.select((F.col("spot") + 1).alias("x"))  # buckets of 32,768 bits start at 1
    for r in x.groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m")).toLocalIterator():
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    kind = held.schema["first"].dataType.simpleString()
    runs = held.mapInArrow(_runs(spark.sparkContext.broadcast(bits), lengths), f"run binary, first {kind}")
    least = runs.groupBy("run").agg(F.min("first").alias("first"))
    whole = want.where("needle <> ''").withColumn("run", F.col("needle").cast("binary"))
    return whole.join(least, "run").select("needle", "first").unionByName(every)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def stem(surface: Column, cut: int = 2, least: int = 4) -> Column:
    """The surface without its last two characters, four at least; the surface holds it, so texts that hold the one hold the other."""
    return F.substr(surface, F.lit(1), F.greatest(F.lit(least), F.length(surface) - cut))


def located(rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """rows with `located` (a paragraph's id) and `rule`: own, context, surface, or null for neither.

    rows: paragraph_id, context, surface and any others. paragraphs: paragraph_id (unique), place (their order), source.
    The first rule that gives a paragraph counts: its own id if there is such a paragraph; the first paragraph in order
    that holds the first 60 characters of its context; the first that holds its surface's stem. Blanks around a context
    don't count, an empty one gives nothing; a null surface neither. Rows with equal values each get their own row.
    """
    ids = paragraphs.select(F.col("paragraph_id").alias("_own"))
    rows = rows.join(ids, rows["paragraph_id"] == F.col("_own"), "left")
    probe = F.substr(stripped(F.col("context")), F.lit(1), F.lit(PROBE))
    open_ = F.col("_own").isNull()
    rows = rows.withColumn("_probe", F.when(open_ & (probe != ""), probe)).withColumn("_stem", F.when(open_, stem(F.col("surface"))))
    needles = rows.select(F.explode(F.array("_probe", "_stem")).alias("needle"))
    order = F.struct("place", F.col("paragraph_id").alias("key")).alias("first")
    first = first_holding(needles, paragraphs.where("paragraph_id is not null").select(order, "source"), text="source").select("needle", F.col("first.key").alias("at"))
    rows = rows.join(first.select(F.col("needle").alias("_probe"), F.col("at").alias("_by_context")), "_probe", "left")
    rows = rows.join(first.select(F.col("needle").alias("_stem"), F.col("at").alias("_by_stem")), "_stem", "left")
    rule = F.when(F.col("_own").isNotNull(), "own").when(F.col("_by_context").isNotNull(), "context").when(F.col("_by_stem").isNotNull(), "surface")
    rows = rows.withColumn("located", F.coalesce("_own", "_by_context", "_by_stem")).withColumn("rule", rule)
    return rows.drop("_own", "_probe", "_stem", "_by_context", "_by_stem")


def either_way(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left, right) of different names of which one holds the other, without regard to case; equal ones are pairs too.

    left, right: a column `name` each. Names count once in each case they come in; null and empty names match nothing.
    """
    fold = lambda df, c: df.select(F.col("name").alias(c), F.lower("name").alias("low")).where("name <> ''").distinct()
    a, b = fold(left, "left"), fold(right, "right")
    names = lambda df: df.select("low").distinct().withColumn("key", F.col("low"))
    one = holding(a.select("low"), names(b), needle="low", text="low").select(F.col("needle").alias("a"), F.col("key").alias("b"))
    two = holding(b.select("low"), names(a), needle="low", text="low").select(F.col("key").alias("a"), F.col("needle").alias("b"))
    pairs = one.union(two).distinct()
    return pairs.join(a, F.col("a") == a["low"]).drop("low").join(b, F.col("b") == b["low"]).select("left", "right")


def relabelled(mentions: DataFrame, lemmas: DataFrame) -> DataFrame:
    """mentions with the lemma that its surface has in `lemmas`, else its own; `context` of the surface's first mention, and `changed`.

    mentions: place (order), surface, lemma, context. lemmas: surface, lemma, of which a surface's least lemma counts.
    """
    first = mentions.groupBy("surface").agg(F.min(F.struct("place", "context"))["context"].alias("_context"))
    table = lemmas.where("lemma <> ''").groupBy("surface").agg(F.min("lemma").alias("_lemma"))
    both = mentions.join(first, "surface", "left").join(table, "surface", "left")
    lemma = F.coalesce("_lemma", "lemma", "surface")
    return both.select("place", "surface", lemma.alias("lemma"), F.coalesce("_context", "context").alias("context"), (~F.col("lemma").eqNullSafe(lemma)).alias("changed"))

"""Quality rules: fixed base rules, then robust multivariate outliers by the minimum covariance determinant.

Each text gives a vector of transformed statistics. Per language and source, concentration steps look for the
three quarters of the rows whose covariance has the least determinant: start at medians and deviations, take the
rows of least Mahalanobis distance, take their mean and covariance, and again. Every step is two aggregates over
all rows (counts of distance bins, then sums), so no group is ever gathered in one place and none is sampled.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, drop, keep, ship, slices

#: Transformed statistics, with the least standard deviation that counts as one (it keeps constant statistics invertible).
FEATURES = {"word_length": 0.03, "symbol_share": 0.35, "other_share": 0.25, "dup_line_share": 0.5, "repeat_share": 0.5, "variety": 0.03}
#: Rows a group needs for estimates of its own; smaller ones use their language's, then everyone's.
LEAST_ROWS, SHARE, STEPS = 60, 0.75, 6
#: Rejected beyond this normal quantile (4 standard deviations in one dimension's terms) times a margin for heavy tails.
Z_CUT, MARGIN = 4.0, 4.0

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_other long, n_distinct long"


def chi2_quantile(z: float, d: int) -> float:
    """Wilson and Hilferty's approximation at the normal quantile z."""
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


def _classes():
    kind = np.zeros(256, np.uint8)  # 1: starts a code point in a word, 2: symbol, 4: neither letter nor symbol
    kind[:0x80] = 1
    kind[0xC0:] = 1
    kind[[0x20, *range(9, 14)]] = 0
    kind[[*b"#*$%&|<>"]] |= 2
    letters = {*range(65, 91), *range(97, 123), *range(0x80, 256)}
    for b in range(256):
        if kind[b] == 1 and b not in letters:
            kind[b] |= 4
    return kind


KIND = _classes()


def text_stats(texts: list[bytes]) -> list[np.ndarray]:
    """Per text: words, code points in them, symbols, repeated lines, words in repeated 5-word windows, other characters, distinct words."""
    n = len(texts)
    split = [t.split() for t in texts]  # bytes split at \x20 and \x09-\x0D only
    n_words = np.array([len(w) for w in split], np.int64)
    data = KIND[np.frombuffer(b"".join(texts) + b" ", np.uint8)]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    filled = np.array([len(t) > 0 for t in texts])

    def per_text(mask):
        if not n:
            return np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        ends = starts + [len(t) for t in texts]
        return np.where(filled, sums[ends] - sums[starts], 0)

    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            dup[i] = len(lines) - len(set(lines))
    # repeated windows: word hashes of this process, windows hashed with their text's number
    flat = np.fromiter((hash(x) for w in split for x in w), np.int64, int(n_words.sum())).view(np.uint64)
    owner = np.repeat(np.arange(n), n_words)
    repeat = np.zeros(n, np.int64)
    if len(flat) >= 5:
        m = len(flat) - 4
        h = owner[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            for k in range(5):
                h = (h ^ flat[k : k + m]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
        at = np.flatnonzero(owner[:m] == owner[4:])
        h = h[at]
        o = np.argsort(h, kind="stable")
        s = h[o]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        twice = at[o[same[:-1] | same[1:]]]
        edge = np.zeros(len(flat) + 5, np.int64)
        edge[twice] += 1
        edge[twice + 5] -= 1
        repeat = np.bincount(owner, weights=np.cumsum(edge)[: len(flat)] > 0, minlength=n).astype(np.int64)
    return [n_words, per_text(data & 1), per_text(data & 2 > 0), dup, repeat, per_text(data & 4 > 0), np.array([len(set(w)) for w in split], np.int64)]


def _stats(batches):
    import pyarrow as pa

    for batch in batches:
        texts = column(batch, "text")
        parts = [text_stats(texts[a:b]) for a, b in slices(texts)] or [text_stats([])]
        cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *cols], [x.split()[0] for x in STATS.split(", ")])


def stats(docs: DataFrame) -> DataFrame:
    """The base statistics of every whole text; a null text is empty."""
    ship(docs.sparkSession)
    cols = [F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")]
    return docs.select(*cols).mapInArrow(_stats, STATS)


def vectors(s: DataFrame) -> DataFrame:
    """The transformed statistics x0.. of each row of stats(), and base_failed."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    x = [F.log(chars / n), F.log1p(1000 * F.col("n_symbols") / chars), F.log1p(100 * F.col("n_other") / chars), F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n), F.log(F.greatest("n_distinct", F.lit(1))) / F.log(n + 1)]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return s.select("*", failed.alias("base_failed"), *[v.cast("double").alias(f"x{i}") for i, v in enumerate(x)])


#: Groups of at most so many rows in all are broadcast (under 1 kB each); more are joined by salted keys.
FEW_GROUPS, SALTS = 50_000, 32


def _beside(rows: DataFrame, groups: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """rows with what groups, which has one row a key, says of them; a hot key's rows never meet in one task."""
    if few:
        return rows.join(F.broadcast(groups), on, how)
    names = [c for c in rows.columns if c not in on]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *names), F.lit(SALTS)))
    every = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(every, [*on, "_salt"], how).drop("_salt")


def _by_share(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The least bin at which the rows of a key reach the share; binned has keys and a long column bin. Aggregated before any shuffle."""
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    cum = counts.select(*keys, "bin", F.sum("n").over(w.orderBy("bin")).alias("to"), F.sum("n").over(w).alias("of"))
    return cum.where(F.col("to") >= share * F.col("of")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _distance(d: int):
    """Squared distance of x0.. to m0.. in the metric p0.. (the upper triangle of the inverse covariance, off-diagonal doubled)."""
    c = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(d)]
    terms = [c[i] * c[j] * F.col("p")[i * d + j] for i in range(d) for j in range(i, d)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(1e-12))


BINS = 64  # distance bins per doubling


def _bin_of(d2):
    return F.floor(F.log2(d2) * BINS)


def _invert(floors):
    d = len(floors)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw = b.to_pydict()
            p = []
            for r in range(b.num_rows):
                c = np.zeros((d, d))
                for i in range(d):
                    for j in range(i, d):
                        c[i, j] = c[j, i] = raw[f"s{i}_{j}"][r] - raw[f"m{i}"][r] * raw[f"m{j}"][r]
                inv = np.linalg.inv(c + np.diag(np.square(floors)))
                p.append((np.triu(inv) + np.triu(inv, 1)).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column("g"), *(b.column(f"m{i}") for i in range(d)), pa.array(p, pa.list_(pa.float64()))], ["g", *(f"m{i}" for i in range(d)), "p"])

    return run


def estimates(rows: DataFrame, d: int, floors: list[float], few: bool = True, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Centre m0.., metric p and scale of each group g of rows (g, x0..). scale: d2 / scale is about chi-squared."""
    x = [f"x{i}" for i in range(d)]
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("x")) for i, c in enumerate(x)])).alias("e")).select("g", "e.f", "e.x")
    mid = _by_share(long.select("g", "f", F.floor(F.col("x") * 4096).alias("bin")), ["g", "f"], 0.5).select("g", "f", (F.col("bin") / 4096).alias("m"))
    mid = keep(mid)
    away = _beside(long, mid, ["g", "f"], few).select("g", "f", F.floor(F.abs(F.col("x") - F.col("m")) * 4096).alias("bin"))
    mad = _by_share(away, ["g", "f"], 0.5).select("g", "f", (F.col("bin") / 4096 * 1.4826).alias("s"))
    both = mid.join(mad, ["g", "f"])
    floor_of = F.array(*map(F.lit, floors))
    first = both.groupBy("g").agg(*[F.max(F.when(F.col("f") == i, F.col("m"))).alias(f"m{i}") for i in range(d)], *[F.max(F.when(F.col("f") == i, F.pow(F.greatest("s", floor_of[i]), -2))).alias(f"q{i}") for i in range(d)])
    diag = [F.col(f"q{i}") if i == j else F.lit(0.0) for i in range(d) for j in range(d)]
    now = keep(first.select("g", *[f"m{i}" for i in range(d)], F.array(*diag).alias("p")))
    schema = "g string, " + ", ".join(f"m{i} double" for i in range(d)) + ", p array<double>"
    for _ in range(steps):
        at = _beside(rows, now, ["g"], few).select("g", *x, _bin_of(_distance(d)).alias("bin"))
        near = _beside(at, _by_share(at.select("g", "bin"), ["g"], share).withColumnRenamed("bin", "to"), ["g"], few).where("bin <= to")
        sums = near.groupBy("g").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.avg(F.col(x[i]) * F.col(x[j])).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)])
        nxt = keep(sums.mapInArrow(_invert(floors), schema))
        drop(now)
        now = nxt
    z = 0.6744897501960817  # of 0.75; the scale makes that share of distances meet chi-squared's
    at = _beside(rows, now, ["g"], few).select("g", _bin_of(_distance(d)).alias("bin"))
    scale = _by_share(at, ["g"], 0.75).select("g", (F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS) / chi2_quantile(z, d)).alias("scale"))
    out = keep(now.join(scale, "g"))
    drop(now, mid)
    return out


def judge(docs: DataFrame, z_cut: float = Z_CUT, margin: float = MARGIN) -> DataFrame:
    """One row per row of docs: the base statistics, base_failed, kept, and outlier_d2 (null where nothing was estimated).

    A null text has no words and fails. Null languages and sources are groups of their own. The small groups of a language
    (under LEAST_ROWS usable rows each) share one estimate if they have so many rows together; the others share one with the
    small groups of all languages, however few rows that leaves. Where nothing can be estimated base rules alone decide.
    """
    s = keep(vectors(stats(docs)))
    floors = list(FEATURES.values())
    d = len(floors)
    nil = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    lang, pair = nil("lang"), F.concat_ws("\x1f", nil("lang"), nil("source"))
    usable = s.where(~F.col("base_failed"))
    n_of = usable.groupBy(lang.alias("l"), pair.alias("k")).agg(F.count("*").alias("n"))
    n_of = n_of.select("*", F.when(F.col("n") >= LEAST_ROWS, F.col("k")).alias("g"))
    rest = n_of.where("g is null").groupBy("l").agg(F.sum("n").alias("of"))
    names = n_of.join(rest, "l", "left").select("k", F.coalesce("g", F.when(F.col("of") >= LEAST_ROWS, F.concat("l", F.lit("\x1f*"))), F.lit("*")).alias("g"))
    names = keep(names)
    few = names.count() <= FEW_GROUPS
    named = _beside(usable.withColumn("k", pair), names, ["k"], few).select("g", *[f"x{i}" for i in range(d)])
    fitted = estimates(named, d, floors, few)
    cut = chi2_quantile(z_cut, d) * margin
    out = _beside(_beside(s.withColumn("k", pair), names, ["k"], few, "left"), fitted, ["g"], few, "left")
    enough = F.col("g").isNotNull() & F.col("p").isNotNull()
    d2 = F.when(enough, _distance(d) / F.col("scale"))
    out = out.withColumn("outlier_d2", d2)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("outlier_d2"), F.lit(0.0)) <= cut)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("outlier_d2"), *[F.col(f"x{i}").alias(c) for i, c in enumerate(FEATURES)])

"""Statistics of evaluation runs: intervals, F1, percentiles by three rules, rank correlation, ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.operators.cuts import cut


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of k in n, clamped, four places; (0, 1) for none."""
    p, zz = k / n, F.lit(z * z)
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return F.when(n > 0, F.round(low, 4)).otherwise(0.0), F.when(n > 0, F.round(high, 4)).otherwise(1.0)


def ratio(k: Column, n: Column) -> Column:
    return F.when(n > 0, k / n)


def macro_f1(pairs: DataFrame, true: str, pred: str, labels: list[str]) -> DataFrame:
    """Mean F1 over the labels that occur in truth, four places."""
    per = pairs.select(F.explode(F.array(*map(F.lit, labels))).alias("label"), true, pred).groupBy("label").agg(
        F.count_if((F.col(true) == F.col("label")) & (F.col(pred) == F.col("label"))).alias("tp"), F.count_if(F.col(true) == F.col("label")).alias("t"), F.count_if(F.col(pred) == F.col("label")).alias("p"))
    f1 = F.when(F.col("t") + F.col("p") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)
    return per.where("t > 0").agg(F.round(F.avg(f1), 4).alias("macro_f1"), F.count("*").alias("n_labels"))


def confusion(pairs: DataFrame, true: str, pred: str, labels: list[str]) -> DataFrame:
    """A dense table with zeros; pairs outside the labels don't count."""
    spark = pairs.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("truth")).select("truth", F.explode(F.array(*map(F.lit, labels))).alias("guess"))
    n = pairs.groupBy(F.col(true).alias("truth"), F.col(pred).alias("guess")).agg(F.count("*").alias("n"))
    return grid.join(n, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_rank(df: DataFrame, key: str, value: str, shares: dict[str, float], rule: str) -> DataFrame:
    """The element at a share of the sorted values: "floor" takes index min(n-1, int(q n)), "ceil" index ceil(q n) - 1."""
    w = Window.partitionBy(key)
    ranked = df.select(key, value, F.row_number().over(w.orderBy(value)).alias("r"), F.count("*").over(w).alias("n"))
    at = lambda q: F.least(F.col("n"), F.floor(F.lit(q) * F.col("n")) + 1) if rule == "floor" else F.ceil(F.lit(q) * F.col("n"))
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("r") == at(q), F.col(value))).alias(c) for c, q in shares.items()], F.max("n").alias("n"))


def spearman(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Correlation of average ranks over rows where both are present; null for fewer than two or a constant side.

    Ranks come from counts of values, so no key's rows meet in one task. Twice a rank is whole, and the sums are exact.
    """
    from lexigauge.operators.paired import running_total

    k = F.struct(F.col(key).alias("k")).alias("_k")  # a null key is a key
    rows = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(k, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_c")))

    def twice(value, name):
        seen = running_total(rows.groupBy("_k", value).agg(F.sum("_c").alias("_n")), ["_k"], value, "_n", "_before")
        return seen.select("_k", value, (2 * F.col("_before") + F.col("_n") + 1).alias(name))

    r = rows.join(twice("_x", "_a"), ["_k", "_x"]).join(twice("_y", "_b"), ["_k", "_y"])
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    of = lambda *names: F.sum(F.col("_c").cast("decimal(10,0)") * (whole(names[0]) if len(names) == 1 else (F.col(names[0]) * F.col(names[1])).cast("decimal(20,0)")))
    s = r.groupBy("_k").agg(F.sum("_c").alias("n"), of("_a").alias("sa"), of("_b").alias("sb"), of("_a", "_b").alias("sab"), of("_a", "_a").alias("saa"), of("_b", "_b").alias("sbb"))
    n = F.col("n").cast("decimal(12,0)")
    about = lambda both, one, two: (n * F.col(both) - F.col(one) * F.col(two)).cast("double")
    top, left, right = about("sab", "sa", "sb"), about("saa", "sa", "sa"), about("sbb", "sb", "sb")
    return s.select(F.col("_k.k").alias(key), "n", F.when((n > 1) & (left > 0) & (right > 0), F.round(top / F.sqrt(left) / F.sqrt(right), 4)).alias("rho"))


def kendall(df: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Tau-b by the pairs of each group; for groups of a few thousand rows. Null when a side is constant."""
    a = df.select(key, F.col(order).alias("i"), F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = df.select(key, F.col(order).alias("j"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    p = a.join(b, key).where("i < j").select(key, F.signum(F.col("xa") - F.col("xb")).alias("s"), F.signum(F.col("ya") - F.col("yb")).alias("t"))
    c = p.groupBy(key).agg(F.sum(F.col("s") * F.col("t")).alias("d"), F.sum(F.abs("s")).alias("u"), F.sum(F.abs("t")).alias("v"))
    return c.select(key, F.when((F.col("u") > 0) & (F.col("v") > 0), F.round(F.col("d") / F.sqrt(F.col("u") * F.col("v")), 4)).alias("tau"))


def ties(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values, the most frequent one (the smallest of equals) and its share."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.count("*").alias("n_distinct"), F.max_by(value, F.struct(F.col("n"), -F.col(value))).alias("modal"), F.round(F.max("n") / F.sum("n"), 4).alias("modal_share"))


def spearman_grid(df: DataFrame, key: str, left: list[str], right: list[str]) -> DataFrame:
    """spearman() of every column of `left` with every one of `right`, by key: key, criterion, metric, n, rho.

    Each cell drops the rows where one of its own two columns is null. A cell without two rows is there with n and a null.
    """
    pairs = [F.struct(F.col(key).alias("k"), F.lit(a).alias("criterion"), F.lit(b).alias("metric")) for a in left for b in right]
    values = [F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a in left for b in right]
    rows = df.select(F.explode(F.arrays_zip(F.array(*pairs).alias("cell"), F.array(*values).alias("v"))).alias("z")).select("z.cell", "z.v.x", "z.v.y")
    got = spearman(rows, "cell", "x", "y")
    every = df.select(key).distinct().select(F.explode(F.array(*pairs)).alias("cell")).join(got, "cell", "left")
    return every.select(F.col("cell.k").alias(key), "cell.criterion", "cell.metric", F.coalesce("n", F.lit(0)).alias("n"), "rho")


def tie_summary(df: DataFrame, key: str, value: str, top: tuple[float, ...] = (9, 10)) -> DataFrame:
    """Per key over present values: n, distinct ones, the most frequent (the smallest of equals), its share, the share of top values, the mean."""
    per = df.groupBy(key, value).agg(F.count("*").alias("c"))
    c, v, here = F.col("c"), F.col(value), F.col(value).isNotNull()
    n = F.sum(F.when(here, c).otherwise(0))
    of = lambda x: F.when(n > 0, F.round(x / n, 4))
    return per.groupBy(key).agg(
        n.alias("n"), F.count_if(here).alias("n_distinct"), F.max_by(value, F.when(here, F.struct(c, -v))).alias("modal"), of(F.max(F.when(here, c))).alias("modal_share"),
        of(F.sum(F.when(v.isin(*top), c).otherwise(0))).alias("top_share"), of(F.sum(v.cast("decimal(18,6)") * c).cast("double")).alias("mean"))

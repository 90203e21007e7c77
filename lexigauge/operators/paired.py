"""Paired tests: signed ranks with ties and zeros, Holm's correction, bootstrap intervals of mean differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.operators.cuts import cut

#: Of erf's approximation by Abramowitz and Stegun (7.1.26), whose error is under 1.5e-7.
ERF_P, ERF = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: The distribution function of a Poisson variable of mean 1 at 0, 1 and so on.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887)


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """df with the total of value over the rows of the same key that come before; rows of a key may fill many tasks.

    `order` must be different within a key. Rows go to tasks by range; each task's totals (a row a key and task) give its start.
    The dealt rows are kept, for a second sampling or coalescing would cut the ranges elsewhere.
    """
    spread = cut(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    last = spread.groupBy("_part", *keys).agg((F.max(F.struct("_own", F.col(value).alias("v")))).alias("m"), F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = last.select("_part", *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    out = spread.join(starts, ["_part", *keys])
    return out.withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with a running number from 0 in an order of all its rows, which must leave no ties; no task holds more than its range of rows.

    The dealt rows are kept, for a second sampling or coalescing would cut the ranges elsewhere.
    """
    spread = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = spread.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return own.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def normal_tail(z: Column) -> Column:
    """The two-sided probability of a standard normal value at least as far out."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def signed_ranks(pairs: DataFrame, keys: Sequence[str], difference: str) -> DataFrame:
    """keys, n, n_zero, w_plus, w_minus, w, z, p per key: Wilcoxon's signed ranks of the differences.

    Null differences don't count; zeros are counted and left out; equal sizes share their mean rank. z has the correction
    for ties, none for continuity; p is its two-sided normal probability. Without a difference other than zero z is null and
    p is 1. Ranks come from counts by size, so no key's rows meet in one task.
    """
    d = pairs.where(F.col(difference).isNotNull()).select(*keys, F.col(difference).alias("d"))
    sizes = d.where("d <> 0").groupBy(*keys, F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running_total(sizes, keys, "size", "n", "before")
    rank = F.col("before") + (F.col("n") + 1) / 2
    own = ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("up") * rank).alias("w_plus"), F.sum((F.col("n") - F.col("up")) * rank).alias("w_minus"), F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("ties"))
    out = d.groupBy(*keys).agg(F.count_if(F.col("d") == 0).alias("n_zero")).join(own, list(keys), "left").fillna(0, ["n", "w_plus", "w_minus", "ties"])
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(spread > 0, (F.col("w_plus") - n * (n + 1) / 4) / spread)
    return out.select(*keys, "n", "n_zero", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("w"), z.alias("z"), F.coalesce(normal_tail(z), F.lit(1.0)).alias("p"))


def holm(tests: DataFrame, family: Sequence[str], p: str = "p", order: Sequence[str] = ()) -> DataFrame:
    """tests with `p_holm`: from the smallest p of a family on, p times the tests left, at most 1, never less than the one before.

    A null p isn't a test and stays null. `order` names columns that settle equal p, which changes no result.
    A family is a set of planned comparisons and small; its tests meet in one task.
    """
    real = F.col(p).isNotNull()
    by = Window.partitionBy(*family, real)
    ranked = by.orderBy(p, *order)
    left = F.count("*").over(by) - F.row_number().over(ranked) + 1
    step = F.when(real, F.least(F.lit(1.0), F.col(p) * left))
    return tests.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(ranked.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def weights(unit: Column, seed: int, replicates: int) -> Column:
    """An array of (replicate, weight), weights being Poisson of mean 1 by the digest of seed, unit and replicate: four a digest."""
    one = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), unit.cast("string"), i.cast("string")))

    def four(i):
        digest = one(i)
        parts = []
        for j in range(4):
            u = F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("double") / 2.0**32
            weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
            parts.append(F.struct((i * 4 + j).alias("replicate"), weight.alias("weight")))
        return F.array(*parts)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(replicates // 4 - 1)), four))


def bootstrap(pairs: DataFrame, keys: Sequence[str], unit: str, difference: str, replicates: int = 200, seed: int = 1, level: int = 95) -> DataFrame:
    """keys, mean, low, high per key: the mean difference and the interval of its bootstrap means, by rank of the replicates.

    Every replicate weighs each unit by a Poisson number of its own instead of drawing units: one aggregate makes all of
    them wherever the rows lie, and a run again gives the same numbers. A unit's rows share their weight. Replicates in which
    a key weighs nothing don't count. replicates: a multiple of four; level: percent.
    """
    if replicates < 4 or replicates % 4:
        raise ValueError("replicates must be a multiple of four")
    d = pairs.where(F.col(difference).isNotNull() & F.col(unit).isNotNull()).select(*keys, F.col(unit).alias("_unit"), F.col(difference).alias("_d"))
    each = d.groupBy(*keys, "_unit").agg(F.sum("_d").alias("_d"), F.count("*").alias("_n"))
    drawn = each.select(*keys, "_d", "_n", F.explode(weights(F.col("_unit"), seed, replicates)).alias("_r")).where("_r.weight > 0")
    means = drawn.groupBy(*keys, F.col("_r.replicate").alias("_i")).agg((F.sum(F.col("_r.weight") * F.col("_d")) / F.sum(F.col("_r.weight") * F.col("_n"))).alias("_m"))
    at = Window.partitionBy(*keys).orderBy("_m", "_i")  # as many rows as replicates
    ranked = means.withColumn("_k", F.row_number().over(at)).withColumn("_of", F.count("*").over(Window.partitionBy(*keys)))
    end = lambda percent: F.min(F.when(200 * F.col("_k") >= F.col("_of") * percent, F.col("_m")))
    ends = ranked.groupBy(*keys).agg(end(100 - level).alias("low"), end(100 + level).alias("high"))
    return d.groupBy(*keys).agg(F.avg("_d").alias("mean")).join(ends, list(keys), "left").select(*keys, "mean", "low", "high")

"""Views over append-only score facts: (para, crit, value, kind, ts, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWEST = (F.desc, ("ts", "id"))


def newest(df: DataFrame, keys: list[str], rank: int = 1) -> DataFrame:
    """The rank-th newest row of each key (ties by id). Rank 1 is the latest, 2 the previous one."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in NEWEST[1]])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == rank).drop("_r")


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("kind").isin("seed", "live"))


def normalised(value: Column, lo: Column, hi: Column) -> Column:
    """Min-max position; 0 on an empty scale. Decimal, so that sums don't depend on their order."""
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(F.lit(0.0)).cast("decimal(18,10)")


def weighted(latest: DataFrame, criteria: DataFrame, keys: list[str], scale: float = 10.0) -> DataFrame:
    """Weighted mean of normalised values over enabled criteria, with the key of all enabled ones, scored or not."""
    on = criteria.where("enabled")
    key = on.agg(F.concat_ws("+", F.sort_array(F.collect_list("crit"))).alias("criteria_key"))
    v = latest.join(F.broadcast(on), "crit")  # criteria are a fixed handful
    agg = v.groupBy(*keys).agg(F.sum(normalised(F.col("value"), F.col("lo"), F.col("hi")) * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    return agg.join(F.broadcast(key)).select(*keys, F.round(F.col("s").cast("double") / F.col("w") * scale, 2).alias("aggregate"), "criteria_key")


def consensus(latest: DataFrame, criteria: DataFrame, keys: list[str]) -> DataFrame:
    """Raw weighted mean over the criteria present; 0 for none."""
    v = latest.join(F.broadcast(criteria), "crit", "left")
    return v.groupBy(*keys).agg(F.coalesce(F.sum(F.col("value") * F.col("weight")) / F.sum("weight"), F.lit(0.0)).alias("consensus"))


def carry_forward(df: DataFrame, criteria: DataFrame, places: int = 2) -> DataFrame:
    """Per paragraph and pass (a ts), the aggregate of every enabled criterion's newest value up to then."""
    on = criteria.where("enabled").select("crit", "lo", "hi", "weight")
    rows = df.join(F.broadcast(on.select("crit")), "crit", "left_semi")
    passes = rows.select("para", "ts").distinct()
    grid = passes.join(F.broadcast(on))
    last = rows.groupBy("para", "ts", "crit").agg(F.max_by("value", "id").alias("value"))
    w = Window.partitionBy("para", "crit").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    held = grid.join(last, ["para", "ts", "crit"], "left").withColumn("value", F.last("value", ignorenulls=True).over(w)).where("value is not null")
    return held.groupBy("para", "ts").agg(F.round(F.sum(normalised(F.col("value"), F.col("lo"), F.col("hi")) * F.col("weight")).cast("double") / F.sum("weight") * 10, places).alias("aggregate"), F.count("*").alias("n_crit"))


def best_revision(revisions: DataFrame) -> DataFrame:
    """The revision of highest aggregate (ties to the newest); is_current if it is also the newest one. Cached scores don't count."""
    real = revisions.where("revision is not null and kind <> 'cache'")
    w = Window.partitionBy("para").orderBy(F.desc("aggregate"), F.desc("ts"), F.desc("id"))
    best = real.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    current = revisions.groupBy("para").agg(F.max("revision").alias("current"))
    return best.join(current, "para").select("para", "revision", "aggregate", (F.col("revision") == F.col("current")).alias("is_current"))


def visible(issues: DataFrame, scores: DataFrame) -> DataFrame:
    """Closed issues, open live ones, and open seed ones whose criterion has no live score on the paragraph yet."""
    again = scores.where("kind = 'live'").select("para", "crit").distinct()
    closed = issues.where(F.col("status").isin("accepted", "dismissed"))
    open_live = issues.where("status = 'open' and kind = 'live'")
    open_seed = issues.where("status = 'open' and kind = 'seed'").join(again, ["para", "crit"], "left_anti")
    return closed.unionByName(open_live).unionByName(open_seed.select(issues.columns))


def changed(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows of a history whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old under the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(old.columns).unionByName(new)

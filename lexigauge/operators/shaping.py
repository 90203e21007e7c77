"""Multi-step shaping: redirect chains, merges, groups, segments, offsets, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.operators.paired import numbered


def redirect_chain(titles: DataFrame, redirects: DataFrame, hops: int = 10) -> DataFrame:
    """Where each title ends after following (src, dst) while the next title is new, at most `hops` times.

    Only titles that redirect at all go through the hops; rows without dst are none.
    """
    edges = redirects.where("dst is not null").select(F.col("src").alias("at"), F.col("dst"))
    moving = titles.select("title").distinct().join(edges.select(F.col("at").alias("title")), "title", "left_semi")
    cur = moving.select("title", F.col("title").alias("at"), F.array("title").alias("seen"))
    for _ in range(hops):
        nxt = cur.join(edges, "at", "left")
        go = F.col("dst").isNotNull() & ~F.array_contains("seen", F.col("dst"))
        cur = nxt.select("title", F.when(go, F.col("dst")).otherwise(F.col("at")).alias("at"), F.when(go, F.array_append("seen", F.col("dst"))).otherwise(F.col("seen")).alias("seen"))
    ends = cur.select("title", F.col("at").alias("_end"), (F.size("seen") - 1).alias("_hops"))
    return titles.select("title").join(ends, "title", "left").select("title", F.coalesce("_end", "title").alias("target"), F.coalesce("_hops", F.lit(0)).alias("n_hops"))


def merge_by_priority(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key: each field from the first source (by prio) that has it; the sources' names sorted."""
    pick = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("prio", c))).alias(c) for c in fields]
    return rows.groupBy(key).agg(*pick, F.concat_ws("+", F.sort_array(F.collect_set("source"))).alias("sources"))


def glossary_groups(terms: DataFrame) -> DataFrame:
    """Terms (stem, qid, verdict, translation, pos) grouped by stem and entity; a stem's ungrounded terms fold into its only entity.

    The group's verdict is the worst, its translation the first.
    """
    one = terms.where("qid is not null").groupBy("stem").agg(F.countDistinct("qid").alias("k"), F.min("qid").alias("only")).where("k = 1")
    named = terms.join(one, "stem", "left").withColumn("entity", F.coalesce("qid", "only", F.lit("ungrounded")))
    bad = F.max(F.when(F.col("verdict") == "red", 3).when(F.col("verdict") == "yellow", 2).when(F.col("verdict") == "green", 1).otherwise(0))
    g = named.groupBy("stem", "entity").agg(F.count("*").alias("n"), bad.alias("worst"), F.min_by("translation", "pos").alias("translation"))
    return g.withColumn("worst", F.element_at(F.array(*map(F.lit, ("none", "green", "yellow", "red"))), F.col("worst") + 1))


def decile_picks(rows: DataFrame, key: str, size: str, bins: int = 10) -> DataFrame:
    """The lower-median element of each of `bins` equal bins by rank of size; the remainder past bins * (n // bins) is left out."""
    ranked = numbered(rows.select(key, size), [F.col(size), F.col(key)], "r").crossJoin(rows.agg(F.count("*").alias("n")))  # one row
    step = F.floor(F.col("n") / bins)
    return ranked.where((step > 0) & (F.col("r") < step * bins)).withColumn("bin", F.floor(F.col("r") / step)).where(F.col("r") - F.col("bin") * step == F.floor((step - 1) / 2)).select("bin", key, size)


def ranked(rows: DataFrame, by: str, tie: Sequence[str], descending: bool = True) -> DataFrame:
    """rows with `place` from 1 by a column, missing values as 0; `tie` names columns that settle equal ones, the last of them unique, nulls last."""
    first = F.coalesce(by, F.lit(0))
    order = [first.desc() if descending else first.asc(), *[F.col(c).asc_nulls_last() for c in tie]]
    return numbered(rows, order, "place").withColumn("place", F.col("place") + 1)


def segments(spans: DataFrame, key: str) -> DataFrame:
    """Elementary segments between neighbouring ends of spans (s, e), with how many spans cover each; uncovered ones go."""
    real = F.coalesce(F.col("s") < F.col("e"), F.lit(False)).cast("int")
    # one shuffle: points of equal place and running totals both lie with their key
    points = spans.where(F.col(key).isNotNull()).repartition(key).select(key, F.explode(F.array(F.struct(F.col("s").alias("a"), real.alias("d")), F.struct(F.col("e").alias("a"), (-real).alias("d")))).alias("p"))
    points = points.select(key, "p.a", "p.d").where("a is not null").groupBy(key, "a").agg(F.sum("d").alias("d"))
    along = Window.partitionBy(key).orderBy("a")
    parts = points.select(key, "a", F.lead("a").over(along).alias("b"), F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("n_cover"))
    return parts.where("n_cover > 0 and b is not null")


def offsets(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Where each text starts in its group joined by one character."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)))


def ledger(calls: DataFrame, key: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """Spend so far and whether the call still fits under the cap; costs are whole units."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("spent", F.sum(cost).over(w)).withColumn("fits", F.col("spent") <= cap)

"""Gold against predicted mentions (title, idx, surface, qid, span), and what is counted over the matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.functions import text
from lexigauge.operators.harness import fates, last_of


COLUMNS = ["title", "idx", "surface", "qid", "span"]


def _both(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The mentions of both sides in one table; side tells which they are."""
    half = lambda d, name: d.select(F.lit(name).alias("side"), *COLUMNS)
    return half(gold, "gold").union(half(pred, "pred"))


def _shared(both: DataFrame, keys: list[str], *known: str) -> DataFrame:
    """Rows that share their keys, none of them null, with one of the other side. Each side is read and dealt once.

    known: more keys, which are never null. A test for null would run once more the function that makes them.
    """
    of = Window.partitionBy(*keys, *known)
    there = both.where(" and ".join(f"{k} is not null" for k in keys))
    return there.withColumn("_sides", F.min("side").over(of) != F.max("side").over(of)).where("_sides").drop("_sides")


def strict(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Mentions of both sides with the same place, entity and normalised surface as one of the other side."""
    place = ["title", "idx", "qid"]
    near = _shared(_both(gold, pred).where("surface is not null"), place).withColumn("norm", text.norm(F.col("surface")))  # folds only those at one place
    return _shared(near, place, "norm").drop("norm")


def overlapping(gold: DataFrame, pred: DataFrame, same_entity: bool = True, floor: int = 1) -> DataFrame:
    """Pairs whose ranges overlap, spans floored; equal keys first, so the range is only a residual of a hash or merge join."""
    g, p = gold.alias("g"), pred.alias("p")
    end = lambda t: F.col(f"{t}.idx") + F.greatest(F.col(f"{t}.span"), F.lit(floor))
    on = (F.col("g.title") == F.col("p.title")) & (F.col("g.idx") < end("p")) & (F.col("p.idx") < end("g"))
    return g.join(p, on & (F.col("g.qid") == F.col("p.qid")) if same_entity else on)


def document(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Mentions of both sides whose entity the other side has anywhere in the document."""
    return _shared(_both(gold, pred), ["title", "qid"])


def survival(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Nested counts of gold entities: recognised, found among candidates, resolved; and resolved anywhere in the document.

    Of predictions at one place and span the last by id counts.
    """
    own = lambda d: d.withColumn("span", F.greatest("span", F.lit(0)))
    last = last_of(pred).where("last").withColumn("qid", F.when(F.col("id").isNotNull(), F.col("qid")))
    every = fates(own(gold), own(last)).where("in_gold")
    return every.agg(F.count("*").alias("n_gold"), F.count_if("rec").alias("n_rec"), F.count_if("found").alias("n_found"), F.count_if("ok").alias("n_ok"), F.count_if("in_pred").alias("n_direct"))


def by_class(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Pooled counts by class of distinct (title, qid): tp and fn by the gold class, fp by the predicted one."""
    kind = lambda d: d.where("surface <> ''").groupBy("title", "qid").agg(F.bool_or(F.substring("surface", 1, 1).rlike(r"\p{Lu}")).alias("up"), F.bool_and(F.substring("surface", 1, 1).rlike(r"\p{Lu}")).alias("all_up"))
    name = lambda t: F.when(F.col(f"{t}.all_up"), "named").when(F.col(f"{t}.up"), "ambiguous").otherwise("term")
    g, p = kind(gold).alias("g"), kind(pred).alias("p")
    j = g.join(p, (F.col("g.title") == F.col("p.title")) & (F.col("g.qid") == F.col("p.qid")), "full_outer")
    has_g, has_p = F.col("g.qid").isNotNull(), F.col("p.qid").isNotNull()
    rows = j.select(F.when(has_g, name("g")).otherwise(name("p")).alias("class"), has_g.alias("in_gold"), has_p.alias("in_pred"))
    return rows.groupBy("class").agg(F.count_if(F.col("in_gold") & F.col("in_pred")).alias("tp"), F.count_if(F.col("in_gold") & ~F.col("in_pred")).alias("fn"), F.count_if(~F.col("in_gold") & F.col("in_pred")).alias("fp"))

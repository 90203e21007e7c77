"""Local mentions of paragraphs as tuples over the whole text's tokens, nested tiers of recall, pooled precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.functions.text import token_index, tokens
from lexigauge.operators.stats import wilson


def rebuilt(articles: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """title, same: whether an article's paragraphs in order have the tokens of its text, place by place.

    articles: title (unique), text; paragraphs: title, place, text. Numbers and hashes of tokens are compared, not lists.
    """
    base = Window.partitionBy("title").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    own = paragraphs.select("title", "place", tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("base", F.coalesce(F.sum(F.size("t")).over(base), F.lit(0)))
    digest = lambda start: F.aggregate(F.transform("t", lambda x, i: F.xxhash64(x, (i + start).cast("long"))), F.lit(0).cast("decimal(38,0)"), lambda a, h: (a + h).cast("decimal(38,0)"))
    parts = own.groupBy("title").agg(F.sum(F.size("t")).alias("n"), F.sum(digest(F.col("base"))).alias("h"))
    whole = articles.select("title", tokens(F.coalesce("text", F.lit(""))).alias("t")).select("title", F.size("t").cast("long").alias("m"), digest(F.lit(0)).alias("g"))
    both = whole.join(parts, "title", "left")
    same = (F.col("m") == F.coalesce("n", F.lit(0))) & (F.col("g") == F.coalesce("h", F.lit(0)).cast("decimal(38,0)"))
    return both.select("title", same.alias("same"))


def stitched(articles: DataFrame, paragraphs: DataFrame, mentions: DataFrame) -> DataFrame:
    """mentions with `token`: the place of the token they start in, among all tokens of the article.

    mentions: title, place, start (character in the paragraph), and others. Raises, when run, for an article whose paragraphs
    don't rebuild its text, for then places would lie.
    """
    base = Window.partitionBy("title").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    own = paragraphs.select("title", "place", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_base", F.coalesce(F.sum(F.size(tokens(F.col("_text")))).over(base), F.lit(0)))
    ok = rebuilt(articles, paragraphs)
    rows = mentions.join(own, ["title", "place"]).join(ok, "title")
    stop = F.raise_error(F.concat(F.lit("paragraphs don't rebuild the text of "), F.col("title").cast("string"))).cast("long")
    lead = F.when(F.col("_text").rlike(r"^\s"), 1).otherwise(0)  # blanks at the start part nothing
    local = token_index(F.col("_text"), F.col("start")) - F.when(F.col("start") > 0, lead).otherwise(0)
    token = F.when(F.col("same"), F.col("_base") + local).otherwise(stop)
    return rows.withColumn("token", token).drop("_text", "_base", "same")


def kept_tiers(level: Column, tiers: int = 3) -> Column:
    """The tiers that keep a tuple of this level: all with level 0, else those below the level."""
    return F.filter(F.array(*[F.lit(t) for t in range(tiers)]), lambda t: (level == 0) | (level > t))


def recall_tiers(gold: DataFrame, hit: str, level: str, slices: dict[str, Column], tiers: int = 3, least: int = 30) -> DataFrame:
    """tier, slice, value, n, hits, recall, low, high, underpowered: recall in every tier and in every slice of it.

    A tuple counts in each tier that keeps it, so tiers are nested; a null level is 0. Each slice is cut by itself, and
    "all" holds everything. One pass: tuples are multiplied by their tiers and slices and counted before the shuffle.
    """
    cut = F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(n).alias("slice"), F.coalesce(c.cast("string"), F.lit("none")).alias("value")) for n, c in slices.items()])
    rows = gold.select(F.coalesce(hit, F.lit(False)).alias("hit"), kept_tiers(F.coalesce(level, F.lit(0)), tiers).alias("tiers"), cut.alias("cuts"))
    rows = rows.select("hit", F.explode("tiers").alias("tier"), "cuts").select("hit", "tier", F.explode("cuts").alias("c")).select("hit", "tier", "c.*")
    out = rows.groupBy("tier", "slice", "value").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select("tier", "slice", "value", "n", "hits", F.round(F.col("hits") / F.col("n"), 4).alias("recall"), low.alias("low"), high.alias("high"), (F.col("n") < least).alias("underpowered"))


def linked_precision(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """n, hits, precision, low, high of the different predicted (title, qid) that are gold; predictions without an id don't count."""
    own = predicted.where("qid IS NOT NULL").select("title", "qid").distinct()
    real = gold.where("qid IS NOT NULL").select("title", "qid").distinct().withColumn("real", F.lit(True))
    out = own.join(real, ["title", "qid"], "left").agg(F.count("*").alias("n"), F.count("real").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select("n", "hits", F.when(F.col("n") > 0, F.round(F.col("hits") / F.col("n"), 4)).alias("precision"), low.alias("low"), high.alias("high"))

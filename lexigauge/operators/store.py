"""Rows of the score store as they are shown, merged and billed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.functions.text import verdict
from lexigauge.operators import scores

REFERENCE = "struct<qid:string,url:string,label:string,description:string>"
# Prices of a prompt and a reply token where none is known.
UNKNOWN_PRICE = (1e-5, 3e-5)


def terms(rows: DataFrame) -> DataFrame:
    """Stored terms as shown: JSON decoded (none: null, an empty list, an empty map), verdicts outside the three as null, ids as text.

    rows: id, paragraph_id, source_surface, difficulty, pair_accuracy, grounded_json, candidates_json, trace_json. JSON that can't be
    read is an error when run.
    """
    read = lambda c, kind: F.from_json(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)), kind, {"mode": "FAILFAST"})
    none = F.array().cast(f"array<{REFERENCE}>")
    return rows.select(
        F.col("id").cast("string").alias("id"), "paragraph_id", "source_surface", verdict(F.col("difficulty")).alias("difficulty"), verdict(F.col("pair_accuracy")).alias("pair_accuracy"),
        read("grounded_json", REFERENCE).alias("grounded"), F.coalesce(read("candidates_json", f"array<{REFERENCE}>"), none).alias("candidates"), F.coalesce(read("trace_json", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("trace"),
    )


def evaluated(latest: DataFrame, fresh: DataFrame, criteria: DataFrame) -> DataFrame:
    """para, aggregate, criteria_key after an evaluation: a fresh value stands for the latest of its criterion. latest, fresh: para, crit, value."""
    both = scores.upsert(latest.select("para", "crit", "value"), fresh.select("para", "crit", "value"), ["para", "crit"])
    return scores.weighted(both.join(fresh.select("para").distinct(), "para", "left_semi"), criteria, ["para"])


def merged_issues(own: DataFrame, sent: DataFrame) -> DataFrame:
    """para, id, status, side: closed issues of one's own and all that were sent, the first of equal ids in that order.

    own, sent: para, place (order), id, status.
    """
    closed = own.where("status <> 'open'").withColumn("side", F.lit("own"))
    rows = closed.unionByName(sent.withColumn("side", F.lit("sent")))
    order = Window.partitionBy("para", "id").orderBy("side", "place")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("para", "id", "status", "side")


def shown_issues(asked: DataFrame, issues: DataFrame, active: DataFrame) -> DataFrame:
    """asked (para, place, id) that are open and of an active criterion, in their order. issues: para, id, crit, status; active: crit."""
    good = issues.where("status = 'open'").join(F.broadcast(active.select("crit")), "crit", "left_semi").select("para", "id")
    return asked.join(good, ["para", "id"], "left_semi").select("para", "place", "id")


def to_accept(issues: DataFrame) -> DataFrame:
    """para, n, ids in order: open issues with a suggestion, by paragraph. A paragraph's issues meet in one row."""
    rows = issues.where("status = 'open' AND suggestion <> ''")
    return rows.groupBy("para").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def glossary_with(old: DataFrame, entries: DataFrame, term: str = "term", place: str = "place") -> DataFrame:
    """old with entries put in, keyed by the term in small letters; of entries of one key the last counts. The columns are old's."""
    last = Window.partitionBy(F.lower(term)).orderBy(F.desc(place))
    new = entries.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(old.columns)
    key = lambda df: df.withColumn("_k", F.lower(term))
    return key(old).join(key(new).select("_k"), "_k", "left_anti").select(old.columns).unionByName(new)


def glossary_hits(words: DataFrame, glossary: DataFrame, term: str = "term") -> DataFrame:
    """words with the glossary's other columns, found without regard to case; nulls for none."""
    known = glossary.withColumn("_k", F.lower(term)).drop(term)
    return words.withColumn("_k", F.lower(term)).join(known, "_k", "left").drop("_k")


def costs(calls: DataFrame, prices: DataFrame, name: str = "model") -> DataFrame:
    """calls with `estimate`: prompt tokens and most reply tokens, reasoning that is billed on top included, at the model's prices.

    calls: model, prompt_tokens, max_tokens, reasoning ("max_tokens" where it is billed on top), reasoning_tokens. prices: model,
    price_in, price_out of a token. Unknown models have a careful price of their own.
    """
    more = F.when(F.col("reasoning") == "max_tokens", F.coalesce("reasoning_tokens", F.lit(0))).otherwise(0)
    rows = calls.join(prices, name, "left")
    a, b = F.coalesce("price_in", F.lit(UNKNOWN_PRICE[0])), F.coalesce("price_out", F.lit(UNKNOWN_PRICE[1]))
    cost = F.when(F.col("price_in").isNull() | F.col("price_out").isNull(), F.col("prompt_tokens") * UNKNOWN_PRICE[0] + (F.col("max_tokens") + more) * UNKNOWN_PRICE[1]).otherwise(F.col("prompt_tokens") * a + (F.col("max_tokens") + more) * b)
    return rows.withColumn("estimate", cost).drop("price_in", "price_out")


def existing(documents: DataFrame, *facts: tuple[str, DataFrame, str]) -> DataFrame:
    """documents with a flag for each fact (name, rows, key): whether a row has the document's id."""
    out = documents
    for name, rows, key in facts:
        there = rows.select(F.col(key).alias("doc_id")).distinct().withColumn(name, F.lit(True))
        out = out.join(there, "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def settled_status(status: Column, origin: Column) -> Column:
    """The state of a document's terms: done for those that came with them."""
    return F.when(origin == "seed", "done").otherwise(status)

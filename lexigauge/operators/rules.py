"""Rules over call logs, issues and documents: first failing rule, reasons, transitions, bands, bounded walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a user may set an issue to; an accepted one stays.
TARGETS = ("open", "dismissed", "outdated")


def first_failing(rules: list[tuple[str, Column]], fine: str = "ok") -> Column:
    """The name of the first rule whose condition holds."""
    out = F
    for name, bad in rules:
        out = out.when(bad, F.lit(name))
    return out.otherwise(F.lit(fine))


def reason(status: Column) -> Column:
    return first_failing([("rate_limit", status == 429), ("server", status >= 500), ("auth", status.isin(401, 403))], "client")


def transient(status: Column) -> Column:
    return (status >= 500) | (status == 429)


def move(status: Column, target: Column) -> Column:
    """The status after a request to change it."""
    return F.when((status != "accepted") & target.isin(*TARGETS), target).otherwise(status)


def band(share: Column, other: Column) -> Column:
    most = F.greatest(share, other)
    return F.when(most >= 0.8, "red").when(most >= 0.5, "yellow").otherwise("green")


def dead_starts(calls: DataFrame, key: str, order: list[str], dead: Column, n: int = 2) -> DataFrame:
    """Keys whose first n calls are all dead. The rank limit is pushed below the shuffle, so few rows of a key move."""
    first = calls.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n)
    return first.groupBy(key).agg(F.count_if(dead).alias("_d")).where(F.col("_d") == n).select(key)


def merge_up(items: Column, i: int, by: str = " ") -> Column:
    """Element i (from 0) joined to the one before it; lists without such an element stay."""
    both = F.concat_ws(by, F.get(items, F.lit(i - 1)), F.get(items, F.lit(i)))
    rest = F.slice(items, F.lit(i + 2), F.greatest(F.size(items) - i - 1, F.lit(0)))
    return F.when((F.size(items) > i) & F.lit(i > 0), F.concat(F.slice(items, 1, max(i - 1, 0)), F.array(both), rest)).otherwise(items)


def repair_json(raw: Column) -> Column:
    """JSON out of a reply: fences and trailing commas gone, the outermost braces kept."""
    bare = F.regexp_replace(raw, "```(json)?", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def walk(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of what roots reach over edges (parent, child) in at most so many steps, the least depth of each."""
    found = roots.select(F.col("node"), F.lit(0).alias("depth")).distinct()
    front = found
    for k in range(1, depth + 1):
        new = edges.join(front.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
        front = new.join(found, "node", "left_anti").select("node", F.lit(k).alias("depth"))
        found = found.unionByName(front)
    return found

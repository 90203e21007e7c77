"""Changes of the registry and of the criteria as one ordered set: computed first, then applied; a second time there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE = ["step", "table", "id", "old", "new"]


def _change(df: DataFrame, step: int, table: Column, id: Column, old: Column, new: Column) -> DataFrame:
    return df.select(F.lit(step).alias("step"), table.alias("table"), id.cast("string").alias("id"), old.cast("string").alias("old"), new.cast("string").alias("new"))


def registry_changes(models: DataFrame, wanted: DataFrame, references: DataFrame, default: str, follow: tuple[str, ...] = ("criterion",)) -> DataFrame:
    """step, table, id, old, new: what brings the registry to the wanted models.

    models, wanted: name, params. references: table, id, model. Step 1 inserts wanted models that aren't there (present ones keep
    their params), step 2 points references at the default: all in the tables of `follow`, elsewhere those that name a model;
    step 3 deletes models that aren't wanted and that nothing names once step 2 is done.
    """
    none = F.lit(None)
    missing = wanted.join(models.select("name"), "name", "left_anti")
    insert = _change(missing, 1, F.lit("model"), F.col("name"), none, F.col("params"))
    moves = (~F.col("model").eqNullSafe(F.lit(default))) & (F.col("table").isin(*follow) | F.col("model").isNotNull())
    repoint = _change(references.where(moves), 2, F.col("table"), F.col("id"), F.col("model"), F.lit(default))
    named = references.where(~moves).select(F.col("model").alias("name")).unionByName(references.where(moves).select(F.lit(default).alias("name"))).distinct()
    old = models.join(wanted.select("name"), "name", "left_anti").join(named, "name", "left_anti")
    return insert.unionByName(repoint).unionByName(_change(old, 3, F.lit("model"), F.col("name"), F.col("params"), none))


def migrated(models: DataFrame, references: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """models and references after the changes."""
    gone = changes.where("step = 3").select(F.col("id").alias("name"))
    come = changes.where("step = 1").select(F.col("id").alias("name"), F.col("new").alias("params"))
    moved = changes.where("step = 2").select("table", "id", F.col("new").alias("_new"))
    refs = references.withColumn("id", F.col("id").cast("string")).join(moved, ["table", "id"], "left")
    return models.join(gone, "name", "left_anti").unionByName(come), refs.withColumn("model", F.coalesce("_new", "model")).drop("_new")


def criteria_changes(criteria: DataFrame, scores: DataFrame, issues: DataFrame, removed: list[str], weights: dict[str, tuple[float, float]]) -> DataFrame:
    """step, table, id, old, new: archives what belongs to removed criteria, deletes these, and moves default weights.

    criteria: crit, weight. scores: id, crit, kind. issues: id, crit, status. Rows of removed criteria are archived, never deleted, and
    only while the criterion is there. A weight moves only from its old default. removed and weights are small lists.
    """
    there = criteria.where(F.col("crit").isin(removed)).select("crit")
    archived = F.lit("archived")
    one = _change(scores.where("kind <> 'archived'").join(F.broadcast(there), "crit"), 1, F.lit("score"), F.col("id"), F.col("kind"), archived)
    two = _change(issues.where("status <> 'archived'").join(F.broadcast(there), "crit"), 1, F.lit("issue"), F.col("id"), F.col("status"), archived)
    three = _change(criteria.join(there, "crit", "left_semi"), 2, F.lit("criterion"), F.col("crit"), F.col("weight"), F.lit(None))
    new = F.lit(None).cast("double")
    for name, (a, b) in weights.items():
        new = F.when((F.col("crit") == name) & (F.col("weight") == a), F.lit(float(b))).otherwise(new)
    four = _change(criteria.join(there, "crit", "left_anti").withColumn("_new", new).where("_new IS NOT NULL AND _new <> weight"), 3, F.lit("weight"), F.col("crit"), F.col("weight"), F.col("_new"))
    return one.unionByName(two).unionByName(three).unionByName(four)

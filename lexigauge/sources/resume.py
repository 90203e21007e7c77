"""Runs that may be killed and resumed: results are appended by attempt, finished units are skipped, order is restored."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Run:
    """The attempts of a run in a folder that driver and executors share, one folder each.

    An attempt counts once Spark has committed it (_SUCCESS); one that was killed is written over by the next with its
    number. So a task or a job that runs again adds nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def attempts(self) -> list[int]:
        top, fs = _files(self.spark, self.path)
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        made = [int(n.removeprefix("attempt=")) for n in names if n.startswith("attempt=")]
        return sorted(a for a in made if fs.exists(_files(self.spark, f"{self.path}/attempt={a}/_SUCCESS")[0]))

    def append(self, results: DataFrame) -> int:
        """Writes one attempt and returns its number."""
        made = self.attempts()
        n = made[-1] + 1 if made else 0
        results.write.mode("overwrite").parquet(f"{self.path}/attempt={n}")
        return n

    def rows(self) -> DataFrame | None:
        """All committed rows with their attempt; None before the first."""
        made = self.attempts()
        if not made:
            return None
        out = [self.spark.read.parquet(f"{self.path}/attempt={a}").withColumn("attempt", F.lit(a)) for a in made]
        both = out[0]
        for more in out[1:]:
            both = both.unionByName(more)
        return both


def states(rows: DataFrame, key: str, ok: str = "ok", most_failures: int = 3) -> DataFrame:
    """key, done, failures: a unit is done once an attempt of it is ok, or after so many failed ones. A unit's rows of one attempt are one try."""
    tries = rows.groupBy(key, "attempt").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))
    out = tries.groupBy(key).agg(F.bool_or("ok").alias("good"), F.count_if(~F.col("ok")).alias("failures"))
    return out.select(key, (F.col("good") | (F.col("failures") >= most_failures)).alias("done"), "failures")


def pending(units: DataFrame, rows: DataFrame | None, key: str, most_failures: int = 3) -> DataFrame:
    """The units that no attempt has finished."""
    if rows is None:
        return units
    return units.join(states(rows, key, most_failures=most_failures).where("done").select(key), key, "left_anti")


def merged(units: DataFrame, rows: DataFrame, key: str, place: str, values: Sequence[str], most_failures: int = 3) -> DataFrame:
    """place, key, values of every unit in its first good attempt, nulls after `most_failures` without one; others aren't there.

    A unit's rows of that attempt all come; sort by `place` for the units' own order.
    """
    good = rows.groupBy(key, "attempt").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("_ok")).where("_ok").groupBy(key).agg(F.min("attempt").alias("attempt"))
    found = rows.join(good, [key, "attempt"]).select(key, *values)
    ended = states(rows, key, most_failures=most_failures).where("done").select(key)
    return units.select(key, place).join(ended, key).join(found, key, "left").select(place, key, *values)


def resumed(units: DataFrame, key: str, place: str, work: Callable[[DataFrame], DataFrame], path: str, values: Sequence[str], waves: int = 1, most_failures: int = 3) -> DataFrame:
    """Runs `work` on the units that aren't finished until all are, and returns merged(). Call it again after a crash.

    units: key (unique), place and what work needs. work returns key, ok and `values`, at least a row a unit; a unit without a row
    counts as failed. Units go in `waves`, each of which is safe once written: a crash costs the wave in flight.
    """
    run = Run(units.sparkSession, path)
    for _ in range(most_failures):
        for wave in range(waves):
            left = pending(units, run.rows(), key, most_failures).where(F.pmod(F.xxhash64(key), F.lit(waves)) == wave)
            if left.isEmpty():
                continue
            out = work(left).select(key, "ok", *values)
            run.append(left.select(key).join(out, key, "left").withColumn("ok", F.coalesce("ok", F.lit(False))))
    rows = run.rows()
    return merged(units, rows, key, place, values, most_failures) if rows is not None else units.select(place, key).limit(0)


def ranked_failures(rows: DataFrame, key: str) -> DataFrame:
    """Each unit's tries in order with the number of failures so far."""
    tries = rows.groupBy(key, "attempt").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    so_far = Window.partitionBy(key).orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    return tries.withColumn("failures", F.count_if(~F.col("ok")).over(so_far))

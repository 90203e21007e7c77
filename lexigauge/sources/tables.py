"""The driver's tables in the shapes that the operators take; each has its SQL twin in plans.catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Criterion, scale, weight, enabled.
CRITERIA = (("click", 0.0, 500.0, 4, True), ("error", 0.0, 400.0, 3, True), ("purchase", 0.0, 400.0, 2, True), ("signup", 0.0, 400.0, 1, True), ("view", 0.0, 350.0, 5, False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def criteria(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{c}', {lo}D, {hi}D, {w}, {str(on).lower()})" for c, lo, hi, w, on in CRITERIA)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(crit, lo, hi, weight, enabled)")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as score facts: the user is the paragraph, the type the criterion, k tells kind, revision and status."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k % 10 < 2, "seed").when(k % 10 == 2, "cache").when(k % 10 == 3, "archived").otherwise("live")
    return e.select(F.col("user_id").alias("para"), F.col("event_type").alias("crit"), "value", "ts", F.col("event_id").alias("id"), k.alias("k"), kind.alias("kind"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).where("trim(line) <> ''")


def _named(which: str):
    """The words of texts that are mentions: title, idx, surface, qid. Each kind of word of a slice of texts is judged once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        most = 4 << 20  # bytes of texts handled at a time; a longer one by itself
        for batch in batches:
            titles, texts = batch.column("doc_id"), batch.column("text")
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
                words = pc.split_pattern(pc.fill_null(texts.slice(a, b - a), ""), " ")  # a null text's word is empty, so no mention
                start = words.offsets.to_numpy().astype(np.int64)
                flat = words.flatten()
                long = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False) > 5)  # short words drop out before their letters are picked
                coded = flat.take(pa.array(long)).dictionary_encode()
                kind, kinds = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
                qids = pc.ascii_lower(pc.replace_substring_regex(kinds, "[^A-Za-z]", ""))
                n = pc.binary_length(qids).to_numpy(zero_copy_only=False)
                good = n > 5
                if which == "gold":
                    good &= pc.match_substring_regex(kinds, "^[A-Z]").to_numpy(zero_copy_only=False)
                else:
                    good &= (n % 2 == 1) | (n > 9)
                at = long[good[kind]]
                owner = np.searchsorted(start - start[0], at, "right") - 1
                of = pa.array(kind[good[kind]])
                idx = pa.array((at - (start - start[0])[owner]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([titles.take(pa.array(a + owner)), idx, kinds.take(of), qids.take(of)], ["title", "idx", "surface", "qid"])
                a = b

    return run


def mentions(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Words of documents as mentions: gold are those with a capital, predicted those of an odd or long length, one place early now and then."""
    d = table(spark, sf_dir, "documents")
    w = d.select("doc_id", F.col("text").cast("string")).mapInArrow(_named(which), f"title {d.schema['doc_id'].dataType.simpleString()}, idx int, surface string, qid string")
    if which == "gold":
        return w.withColumn("span", F.lit(1) + F.col("idx") % 2)
    return w.select("title", (F.col("idx") - F.when(F.length("qid") % 5 == 0, 1).otherwise(0)).alias("idx"), "surface", "qid", (F.lit(1) + F.length("qid") % 3).alias("span"), F.col("idx").alias("id"), F.array(F.when(F.length("qid") % 7 != 0, F.col("qid")).otherwise("none"), F.substring("qid", 1, 4)).alias("cands"))

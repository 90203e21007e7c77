"""Files whose rows belong together by their place: numbered lines, and frames zipped by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, skip_blank: bool = True) -> DataFrame:
    """n (from 0), value: the lines of a file, or of several in the order of their names, with their number.

    Spark reads the file in splits. Lines are numbered inside their split, in the order it is read, and splits by their place
    in the file; no task holds more than a split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    if skip_blank:
        raw = raw.where(F.col("value").rlike(r"(?U)\S"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("rows"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    starts = counts.select("file", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return raw.withColumn("own", own).join(starts, ["file", "block"]).select((F.col("start") + F.col("own")).alias("n"), "value")


def numbered_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """n and the fields of JSON lines; fields that are missing are null, a line that is no JSON object an error when run."""
    lines = numbered_lines(spark, path).withColumn("j", F.from_json("value", schema, {"mode": "FAILFAST"}))
    return lines.select("n", "j.*")


def zipped(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames joined by their column n, which counts 0, 1 and on in each; ValueError with all lengths if they differ.

    Lengths and largest numbers come from one small aggregate a frame before the join.
    """
    lengths = {name: df.agg(F.count("*"), F.countDistinct("n"), F.max("n")).first() for name, df in frames.items()}
    if len({r[0] for r in lengths.values()}) > 1:
        raise ValueError(f"rows don't match: {dict((k, r[0]) for k, r in lengths.items())}")
    if odd := [k for k, r in lengths.items() if r[0] and (r[1] != r[0] or r[2] != r[0] - 1)]:
        raise ValueError(f"rows aren't numbered 0, 1 and on: {odd}")
    out = None
    for df in frames.values():
        out = df if out is None else out.join(df, "n")
    return out


def system_scores(spark: SparkSession, root: str, name: str) -> DataFrame:
    """n, accuracy, fluency, style, metricx_ref, metricx_qe, comet of one system, from its four files by row; missing scores are null."""
    top = f"{root.rstrip('/')}/{name}"
    judge = numbered_json(spark, f"{top}/scores.jsonl", "accuracy double, fluency double, style double")
    ref = numbered_json(spark, f"{top}/metricx/scores.jsonl", "prediction double").withColumnRenamed("prediction", "metricx_ref")
    qe = numbered_json(spark, f"{top}/metricx/scores_wo_ref.jsonl", "prediction double").withColumnRenamed("prediction", "metricx_qe")
    whole = spark.read.schema("paragraph_scores array<double>").json(f"{top}/comet/scores.json", multiLine=True)
    comet = whole.select(F.posexplode("paragraph_scores").alias("n", "comet")).withColumn("n", F.col("n").cast("long"))
    return zipped({"scores.jsonl": judge, "metricx/scores.jsonl": ref, "metricx/scores_wo_ref.jsonl": qe, "comet/scores.json": comet})


def gold_articles(spark: SparkSession, path: str) -> DataFrame:
    """title, stratum, place, index, surface, qid, span_len: the gold tuples of a JSON-lines file, a row each, articles in the file's order."""
    lines = numbered_json(spark, path, "title string, stratum string, gt_tuples array<array<string>>")
    t = lines.select("title", "stratum", F.col("n").alias("place"), F.explode("gt_tuples").alias("t"))
    return t.select("title", "stratum", "place", F.get("t", F.lit(0)).cast("long").alias("index"), F.get("t", F.lit(1)).alias("surface"), F.get("t", F.lit(2)).alias("qid"), F.get("t", F.lit(3)).cast("int").alias("span_len"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """title, place, index, surface, lemma, qid, span_len, resolved_by, candidates of a JSON-lines file of predictions."""
    schema = "title string, index long, surface string, lemma string, qid string, span_len int, resolved_by string, candidates array<struct<qid:string,label:string,source:string>>"
    return numbered_json(spark, path, schema).withColumnRenamed("n", "place")


def mentions(spark: SparkSession, path: str) -> DataFrame:
    """paragraph_id, mentions: the mentions of each paragraph in the file's order, missing fields as empty text, -1 or Russian."""
    fields = "surface string, context string, lemma string, char_start int, char_end int, lang string, category string"
    rows = numbered_json(spark, path, f"paragraph_id long, {fields}")
    filled = rows.select("paragraph_id", "n", F.coalesce("surface", F.lit("")).alias("surface"), F.coalesce("context", F.lit("")).alias("context"), "lemma", F.coalesce("char_start", F.lit(-1)).alias("char_start"), F.coalesce("char_end", F.lit(-1)).alias("char_end"), F.coalesce("lang", F.lit("ru")).alias("lang"), "category")
    each = F.struct("n", "surface", "context", "lemma", "char_start", "char_end", "lang", "category")
    return filled.groupBy("paragraph_id").agg(F.sort_array(F.collect_list(each)).alias("mentions"))

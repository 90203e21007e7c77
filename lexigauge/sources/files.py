"""File sources and sinks: JSON lines, tagged titles, chapters; and a guard on failures before a write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FAILED = 0.10
#: What bytes over 127 mean in Latin-1, which Spark decodes, and in Windows-1251, which it does not by default.
LATIN, CYRILLIC = (bytes(range(128, 256)).decode(c, "replace") for c in ("latin-1", "cp1251"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of JSON lines; blank lines are no rows, a line that isn't JSON fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines in UTF-8, sorted where an order is given; the folder must be new."""
    (df.orderBy(*order) if order else df).write.option("ignoreNullFields", "false").json(path)


def write_guarded(df: DataFrame, failed: int, path: str, order: list[str], most: float = MOST_FAILED) -> int:
    """write_jsonl() unless failed of all is more than the given share; returns the rows written."""
    n = df.count()
    if n + failed and failed / (n + failed) > most:
        raise ValueError(f"{failed} of {n + failed} failed")
    write_jsonl(df, path, order)
    return n


def read_titles(spark: SparkSession, path: str, untagged: str = "typical") -> DataFrame:
    """title and stratum from tab-separated lines; a line without a tag is of the untagged stratum."""
    part = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.trim(part[0]).alias("title"), F.coalesce(F.nullif(F.trim(F.get(part, F.lit(1))), F.lit("")), F.lit(untagged)).alias("stratum"))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, text of the blank-line separated paragraphs of whole files; headings and empty ones are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parts = F.filter(F.transform(F.split("value", r"\n\s*\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return whole.select("file", F.posexplode(parts).alias("idx", "text"))


def decode_text(raw, bad: float = 0.10):
    """A binary column as text: UTF-8 where it is valid, else Windows-1251; null where over a tenth are control characters."""
    utf = F.is_valid_utf8(raw.cast("string"))
    text = F.when(utf, raw.cast("string")).otherwise(F.translate(F.decode(raw, "ISO-8859-1"), LATIN, CYRILLIC))
    controls = F.regexp_count(text, F.lit(r"[\x00-\x08\x0E-\x1F]"))
    return F.when(controls <= bad * F.length(text), text)

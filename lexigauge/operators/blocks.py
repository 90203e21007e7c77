"""Markdown as blocks: headings, tables, items, footnotes and paragraphs, as islands of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What each kind of line looks like once its end is trimmed; the first that fits counts.
LINE_KINDS = (("heading", r"^(#{1,6})\s+(.*)$"), ("table", r"^\|(.*)\|\s*$"), ("footnote", r"^\[\^([\w-]+)\]:\s*(.*)$"), ("bullet", r"^-\s+(.*)$"), ("number", r"^(\d+)\.\s+(.*)$"))


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block (from 0), kind, marker, content: one row per block, table rows a line each with cells between tabs.

    A heading or an item starts a block, a line of plain text goes on with the item or paragraph before it, rows of a table
    one after another are one block, blank lines end any. marker: a heading's level, a number or a footnote's name. Hard-wrapped
    lines are joined by blanks. Null and empty texts have no blocks. Rows of equal key are documents of their own only if the
    caller makes keys unique; a document's lines meet in one task, as its text does before.
    """
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("at", "raw"))
    line = F.regexp_replace("raw", r"(?U)\s+$", "")
    kind = F.when(line == "", "blank")
    for name, pattern in LINE_KINDS:
        kind = kind.when(line.rlike(pattern), name)
    lines = lines.select("key", "at", line.alias("line"), kind.otherwise("plain").alias("kind"))
    order = Window.partitionBy("key").orderBy("at")
    before = F.lag("kind", 1, "blank").over(order)
    starts = F.when(F.col("kind") == "blank", False).when(F.col("kind") == "table", before != "table").when(F.col("kind") == "plain", before.isin("blank", "heading", "table")).otherwise(True)
    lines = lines.withColumn("starts", starts.cast("int")).withColumn("block", F.sum("starts").over(order) - 1).where("kind <> 'blank'")
    part = lambda name, group: F.regexp_extract("line", dict(LINE_KINDS)[name], group)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    cells = F.transform(F.split(part("table", 1), r"\|"), strip)
    said = F.when(F.col("kind") == "heading", part("heading", 2)).when(F.col("kind") == "footnote", part("footnote", 2)).when(F.col("kind") == "bullet", part("bullet", 1)).when(F.col("kind") == "number", part("number", 2)).otherwise(F.col("line"))
    said = F.when(F.col("kind") == "table", F.array_join(cells, "\t")).otherwise(strip(said))
    marker = F.when(F.col("kind") == "heading", F.length(part("heading", 1)).cast("string")).when(F.col("kind") == "footnote", part("footnote", 1)).when(F.col("kind") == "number", part("number", 1))
    lines = lines.select("key", "block", "at", "kind", marker.alias("marker"), said.alias("said"))
    first = F.min_by(F.struct("kind", "marker"), "at").alias("first")
    rows = F.sort_array(F.collect_list(F.struct("at", "said"))).alias("rows")
    out = lines.groupBy("key", "block").agg(first, rows)
    words = F.transform("rows", lambda r: r["said"])
    kind_name = F.when(F.col("first.kind") == "plain", "paragraph").otherwise(F.col("first.kind"))
    content = F.when(F.col("first.kind") == "table", F.array_join(words, "\n")).otherwise(strip(F.array_join(words, " ")))
    return out.select(F.col("key").alias(key), "block", kind_name.alias("kind"), F.col("first.marker").alias("marker"), content.alias("content"))

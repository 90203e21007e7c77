"""Documents as Markdown tables and results as HTML, a row of text each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    """Text inside a Markdown table: bars escaped, line ends as breaks."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(c, "\r\n|\n", "<br>")


def markdown(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, markdown: title, head and one line a paragraph in order. Documents without paragraphs have a head alone.

    documents: doc_id (unique), title, source_lang, target_lang. rows: doc_id, place (from 0), source, target. A document's lines meet
    in one row, which is what was asked for.
    """
    line = F.concat(F.lit("| "), (F.col("place") + 1).cast("string"), F.lit(" | "), cell(F.col("source")), F.lit(" | "), cell(F.col("target")), F.lit(" |\n"))
    body = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "").alias("body"))
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n| ¶ | Source ("), F.coalesce("source_lang", F.lit("")), F.lit(") | Translation ("), F.coalesce("target_lang", F.lit("")), F.lit(") |\n|---|---|---|\n"))
    return documents.join(body, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("markdown"))


def escaped(c: Column) -> Column:
    """Text as HTML."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def html_rows(results: DataFrame, columns: list[str], metrics: dict[str, tuple[str, str, str]], least: int = 30) -> DataFrame:
    """results with `html`, a table row: plain columns, then each metric's value and interval, flagged when fewer than `least` stand behind it.

    metrics: name of a value column -> (low, high, n) columns. A null value is a dash.
    """
    number = lambda c: F.coalesce(F.format_string("%.4f", F.col(c).cast("double")), F.lit("–"))
    cells = [F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in columns]
    for value, (low, high, n) in metrics.items():
        flag = F.when(F.col(n) < least, F.lit(f' <span class="flag">underpowered n&lt;{least}</span>')).otherwise("")
        cells.append(F.concat(F.lit("<td>"), F.when(F.col(value).isNull(), "–").otherwise(number(value)), F.lit('<div class="n">['), number(low), F.lit(", "), number(high), F.lit("]"), flag, F.lit("</div></td>")))
    return results.withColumn("html", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")))


def html(rows: DataFrame, heads: list[str], order: list[str], title: str, meta: dict[str, str]) -> DataFrame:
    """One row, html: a report of rows made by html_rows, in order. rows: a result to be read, so a small one."""
    import html as plain

    head = "".join(f"<th>{plain.escape(h)}</th>" for h in heads)
    said = " · ".join(f"{plain.escape(k)} <code>{plain.escape(str(v))}</code>" for k, v in meta.items())
    top = f'<div class="report"><h1>{plain.escape(title)}</h1><div class="meta">{said}</div><table><thead><tr>{head}</tr></thead><tbody>'
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "html"))), lambda x: x["html"]), "")
    return rows.agg(F.concat(F.lit(top), body, F.lit("</tbody></table></div>")).alias("html"))

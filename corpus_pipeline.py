"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Every stage but the last returns the columns of documents: rows go, or lines in them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigauge.llm import decontam, langid, linededup, neardup, packing
from lexigauge.llm.common import keep, quoted, table

#: A text whose language is less probable than this over its words is rejected, as is one without a letter.
LEAST_SCORE = 0.3


def identify(spark, docs, sf_dir):
    """Keeps what has a language. Learns from the labelled rows of its own input, by the folds of the operator."""
    own = docs.columns
    held = {c: f"_{c}" for c in own if c not in ("doc_id", "text", "lang")}
    out = langid.predict(docs.withColumnsRenamed(held))
    out = out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return out.select(*[quoted(held.get(c, c)).alias(c) for c in own])


def dedup_lines(spark, docs, sf_dir):
    """Takes out later lines that equal or resemble earlier ones; texts that lose their last line go, null ones stay."""
    return linededup.dedup(docs)


def dedup_near(spark, docs, sf_dir):
    """Keeps one document of each group of near copies; texts without a word stay."""
    return neardup.dedup(docs)


def decontaminate(spark, docs, sf_dir):
    """Drops documents that hold a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """Pieces of all that is left, placed in sequences."""
    return packing.pack(docs)


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("packing", pack)]

#: Language ID, seeds and tokenizers are beyond SQL; tests hold the operators of the stages against brute force and run() on a small table whose outcome is known.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. Each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs

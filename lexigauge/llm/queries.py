"""The queries of this folder, as the driver runs them: each applies an operator to its whole table."""

from __future__ import annotations

from . import brown, decontam, funnel, langid, licenses, linededup, neardup, packing, pii, quality, repair, reuse, urls
from .common import table


def op1_brown_scores(spark, sf_dir):
    """Scores of all texts under class bigrams learned from four folds; a null text is the end alone."""
    return brown.score(table(spark, sf_dir, "documents"))


def op2_spaced_seed_decontamination(spark, sf_dir):
    """Documents and benchmark items that overlap; null and empty texts overlap with nothing."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mcd_quality(spark, sf_dir):
    """Base statistics and verdict of every text; null and short texts fail."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_deobfuscated_pii(spark, sf_dir):
    """Personal data in every text, plain and disguised; none in null and empty ones."""
    return pii.spans(table(spark, sf_dir, "documents"))


def op5_redirect_url_filter(spark, sf_dir):
    """A verdict for every page by its rules and those of what it redirects to; pages without a host are on their own."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_bin_completion_packing(spark, sf_dir):
    """The pieces of every text and their places in sequences; a null text is its end id."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_prefix_filter_line_dedup(spark, sf_dir):
    """Lines that go and links of every document; null texts have none."""
    return linededup.report(table(spark, sf_dir, "documents"))


def op8_probminhash_classes(spark, sf_dir):
    """The near-duplicate class of every document; texts without a word are on their own."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op9_license_classifier(spark, sf_dir):
    """Licence notices of every text; null texts have none."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_crf_language(spark, sf_dir):
    """The language of every text, und for null ones and those without a letter."""
    out = langid.predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "n_words", "second", "n_switches")


def op11_ordered_funnels(spark, sf_dir):
    """Funnels of every client; rows with a null in client, kind or arrival don't count."""
    return funnel.count(table(spark, sf_dir, "clicks"))


def op12_conversation_repair(spark, sf_dir):
    """Damages every conversation and repairs it; nulls become blanks first."""
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_chunked_bpe(spark, sf_dir):
    """Ids and decoded text of every document, as digests; a null text has no ids."""
    return reuse.digests(table(spark, sf_dir, "documents"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("op") and callable(f)}

#: Equal results in SQL, where it can say them.
SQL: dict[str, str] = {"op5_redirect_url_filter": urls.SQL, "op11_ordered_funnels": funnel.sql()}

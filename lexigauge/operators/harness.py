"""Whole results of evaluation runs: survival with its rates, pairing, grounding, winners, and the validation of uploads."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.operators.stats import wilson

# Ways in which a mention is settled, and those that asked the judge.
WAYS = ("exact_label", "llm_disambiguation", "judge_rejected", "judge_unavailable", "wikidata_unavailable", "no_candidates")
ESCALATED = ("llm_disambiguation", "judge_rejected", "judge_unavailable")
# Most paragraphs of an upload, most characters of a paragraph, of a title and of a language.
MOST_PARAGRAPHS, MOST_CHARS, MOST_TITLE, MOST_LANGUAGE = 40, 4000, 120, 40
BUCKET = 64


def _buckets(place: Column, span: Column, explode=F.explode) -> Column:
    return explode(F.sequence(F.floor(place / BUCKET), F.floor((place + F.greatest(span, F.lit(0))) / BUCKET)))


def last_of(pred: DataFrame) -> DataFrame:
    """pred with `last`: whether a row is the one of greatest id at its place and span. Where no id is known its answer counts as null."""
    later = F.lead(F.lit(True)).over(Window.partitionBy("title", "idx", "span").orderBy(F.col("id").asc_nulls_first()))
    return pred.withColumn("last", later.isNull())


def fates(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """title, qid, in_gold, in_pred, rec, found, ok, direct: what becomes of every (title, qid) of gold or pred.

    rec: one of its mentions overlaps a prediction that is `last`; found: such a one has it among its candidates; direct: as its
    id; ok: both at once. in_pred: pred names it, last or not. Ranges meet by buckets of 64 tokens, so a long document is dealt to
    many tasks. Each side is read once: what meets nothing comes out of the join as well.
    """
    g = gold.select("title", "qid", F.col("idx").alias("a"), F.col("span").alias("an"), _buckets(F.col("idx"), F.col("span"), F.explode_outer).alias("bucket"), F.lit(True).alias("is_gold"))
    known = lambda c: F.when(F.col("id").isNotNull(), F.col(c)) if "id" in pred.columns else F.col(c)
    p = pred.select(F.col("title").alias("t"), F.col("qid").alias("said"), known("qid").alias("got"), known("cands").alias("cands"), F.col("idx").alias("b"), F.col("span").alias("bn"), "last", _buckets(F.col("idx"), F.col("span"), F.explode_outer).alias("at"))
    on = (F.col("title") == F.col("t")) & (F.col("bucket") == F.col("at")) & (F.col("a") < F.col("b") + F.col("bn")) & (F.col("b") < F.col("a") + F.col("an")) & F.col("last")
    met = g.join(p, on, "full_outer")
    yes, no = lambda c: F.coalesce(c, F.lit(False)), F.lit(False)
    has, same = F.array_contains("cands", F.col("qid")), F.col("got") == F.col("qid")
    flags = ("in_gold", "in_pred", "rec", "found", "ok", "direct")
    row = lambda title, qid, side, *f: F.struct(title.alias("title"), qid.alias("qid"), F.when(title.isNull() | qid.isNull(), side).alias("_own"), *[c.alias(n) for n, c in zip(flags, f)])  # noqa: E731  no title or id equals nothing of the other side
    mine = F.when(F.col("is_gold"), row(F.col("title"), F.col("qid"), "gold", F.lit(True), no, yes(F.col("last")), yes(has), yes(has & same), yes(same)))
    other = F.when(F.col("said").isNotNull(), row(F.col("t"), F.col("said"), "pred", no, F.lit(True), no, no, no, no))
    each = met.select(F.explode(F.array_compact(F.array(mine, other))).alias("x")).select("x.*")
    return each.groupBy("title", "qid", "_own").agg(*[F.bool_or(f).alias(f) for f in flags]).drop("_own")


def survival_rates(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """metric, matched, total, value, low, high: what becomes of gold entities, stage by stage, and pooled precision.

    gold: title, qid, idx, span; pred: title, idx, span, qid (or null), cands (ids, or null). Of predictions at one place and span
    the last by `id` counts, where there is such a column. An entity is recognised when any of its mentions is overlapped; found
    when an overlapping prediction has it among its candidates; resolved when one has it as its id. R counts found and resolved
    ones, R_direct all resolved ones, their difference is miss. P: of different predicted (title, qid) those that are gold.
    """
    every = fates(gold, last_of(pred) if "id" in pred.columns else pred.withColumn("last", F.lit(True)))
    own = lambda *flags: F.count_if(functools.reduce(Column.__and__, map(F.col, ("in_gold", *flags))))
    both = every.agg(own().alias("n"), own("rec").alias("rec"), own("found").alias("found"), own("found", "direct").alias("ok"), own("direct").alias("direct"), F.count_if(F.col("in_gold") & F.col("direct") & ~F.col("found")).alias("miss"), F.count_if("in_pred").alias("linked"), own("in_pred").alias("linked_real"))
    pairs = (("R_NER", "rec", "n"), ("R_search", "found", "rec"), ("A_disamb", "ok", "found"), ("R", "ok", "n"), ("R_direct", "direct", "n"), ("P", "linked_real", "linked"), ("miss", "miss", "n"))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(a).alias("matched"), F.col(b).alias("total")) for m, a, b in pairs]))
    out = both.select(cells.alias("c")).select("c.*")
    low, high = wilson(F.col("matched"), F.col("total"))
    return out.select("metric", "matched", "total", F.when(F.col("total") > 0, F.round(F.col("matched") / F.col("total"), 4)).alias("value"), low.alias("low"), high.alias("high"))


def f1(truth: str, said: str, label: str) -> Column:
    t, p = F.col(truth) == label, F.coalesce(F.col(said) == label, F.lit(False))
    hit, miss = F.count_if(t & p), F.count_if(t & ~p) + F.count_if(~t & p)
    return F.when(2 * hit + miss > 0, 2 * hit / (2 * hit + miss)).otherwise(0.0)


def macro_f1(truth: str, said: str, labels: tuple[str, ...] = ("green", "yellow", "red")) -> Column:
    """The mean F1 of the labels that occur in truth, four places; 0 for none."""
    there = [F.count_if(F.col(truth) == x) > 0 for x in labels]
    total = sum((F.when(t, f1(truth, said, x)).otherwise(0.0) for t, x in zip(there, labels)), F.lit(0.0))
    n = sum((t.cast("int") for t in there), F.lit(0))
    return F.round(F.when(n > 0, total / n).otherwise(0.0), 4)


def pairing_scores(rows: DataFrame, key: str) -> DataFrame:
    """key, n_non_red, verdict_f1, null_accuracy, recommended_accuracy, recommended_n per key.

    rows: gold_difficulty, gold_pair, pred_pair, gold_recommended, pred_recommended. Verdicts count where the term isn't red, a
    missing one as red; red terms should have none; a recommendation counts where the verdict is right and gold has one.
    """
    red = F.col("gold_difficulty") == "red"
    rows = rows.withColumn("_truth", F.when(~red, F.col("gold_pair"))).withColumn("_said", F.when(~red, F.coalesce("pred_pair", F.lit("red"))))
    fold = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    scope = ~red & F.coalesce(F.col("pred_pair") == F.col("gold_pair"), F.lit(False)) & (F.coalesce("gold_recommended", F.lit("")) != "")
    share = lambda k, n: F.when(n > 0, F.round(k / n, 4))
    return rows.groupBy(key).agg(
        F.count_if(~red).alias("n_non_red"),
        macro_f1("_truth", "_said").alias("verdict_f1"),
        share(F.count_if(red & F.col("pred_pair").isNull()), F.count_if(red)).alias("null_accuracy"),
        share(F.count_if(scope & (fold("pred_recommended") == fold("gold_recommended"))), F.count_if(scope)).alias("recommended_accuracy"),
        F.count_if(scope).alias("recommended_n"),
    )


def grounding_metrics(rows: DataFrame, key: str) -> DataFrame:
    """key, n, n_groundable, correct, accuracy, low, high, red_hit, red_total, escalation_rate and n_<way> for every way, 0 for absent ones.

    rows: gold_difficulty, pred_difficulty, gold_qid, pred_qid, resolved_by.
    """
    due = F.col("gold_difficulty").isin("green", "yellow")
    red = F.col("gold_difficulty") == "red"
    out = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(due).alias("n_groundable"),
        F.count_if(due & (F.col("pred_qid") == F.col("gold_qid"))).alias("correct"),
        F.count_if(red & (F.col("pred_difficulty") == "red")).alias("red_hit"),
        F.count_if(red).alias("red_total"),
        F.round(F.count_if(F.col("resolved_by").isin(*ESCALATED)) / F.count("*"), 4).alias("escalation_rate"),
        *[F.count_if(F.col("resolved_by") == w).alias(f"n_{w}") for w in WAYS],
    )
    low, high = wilson(F.col("correct"), F.col("n_groundable"))
    return out.withColumns({"accuracy": F.when(F.col("n_groundable") > 0, F.round(F.col("correct") / F.col("n_groundable"), 4)), "low": low, "high": high})


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, p50, p95, max, n: the value of rank floor(q * n) from 0, one place. Values of a key are counted first, so ties cost nothing."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    up = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    at = lambda percent: F.round(F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * percent / 100)), F.col(value))), 1)
    return counts.groupBy(key).agg(at(50).alias("p50"), at(95).alias("p95"), F.round(F.max(value), 1).alias("max"), F.max("n").alias("n"))


def ranking(strategies: DataFrame, name: str) -> DataFrame:
    """strategies with place and winner: more accuracy, then more F1, fewer calls, less latency; nulls count as 0, the name last.

    strategies: accuracy, f1, calls, p50; a row a strategy, so few.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    order = Window.orderBy(zero("accuracy").desc(), zero("f1").desc(), zero("calls"), zero("p50"), name)
    return strategies.withColumn("place", F.row_number().over(order).cast("long")).withColumn("winner", F.col("place") == 1)


def paired_rows(first: DataFrame, second: DataFrame, place: str) -> DataFrame:
    """Rows of both by place; raises when run if a place is missing on one side or repeated, for then rows would be lost."""
    own = lambda df, side: df.withColumn("_n", F.count("*").over(Window.partitionBy(place))).withColumn(f"_{side}", F.lit(True))
    a, b = own(first, "a"), own(second, "b").withColumnRenamed("_n", "_m")
    both = a.join(b, place, "full_outer")
    bad = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_n") > 1) | (F.col("_m") > 1)
    stop = F.raise_error(F.concat(F.lit("rows don't match at place "), F.col(place).cast("string")))
    return both.withColumn("_ok", F.when(bad, stop.cast("boolean")).otherwise(True)).where("_ok").drop("_n", "_m", "_a", "_b", "_ok")


def upload_verdicts(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, verdict: the first rule that an upload breaks, or null.

    documents: doc_id, title, source_lang, target_lang, translate. pairs: doc_id, place, source, target. Rules: title, languages, equal
    languages, no paragraphs, too many; then the first paragraph in order with an empty cell or too many characters (the source
    alone when it is to be translated); then a target in an upload that is to be translated.
    """
    from lexigauge.functions.names import on_one_line, strip

    said = lambda c: F.coalesce(c, F.lit(""))
    d = documents.select("doc_id", said("title").alias("title"), on_one_line(said("source_lang")).alias("a"), on_one_line(said("target_lang")).alias("b"), F.coalesce("translate", F.lit(False)).alias("translate"))
    source, target = said("source"), said("target")
    p = pairs.join(d.select("doc_id", "translate"), "doc_id").select("doc_id", "place", "translate", source.alias("s"), target.alias("t"))
    empty = (strip(F.col("s")) == "") | (~F.col("translate") & (strip(F.col("t")) == ""))
    long = (F.length("s") > MOST_CHARS) | (~F.col("translate") & (F.length("t") > MOST_CHARS))
    fault = F.when(empty, F.concat(F.lit("empty_cell:"), F.col("place").cast("string"))).when(long, F.concat(F.lit("paragraph_too_long:"), F.col("place").cast("string")))
    of = p.withColumn("fault", fault).groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("fault").isNotNull(), F.struct("place", "fault")))["fault"].alias("fault"), F.bool_or(strip(F.col("t")) != "").alias("filled"))
    out = d.join(of, "doc_id", "left")
    lang = lambda c: (F.col(c) == "") | (F.length(c) > MOST_LANGUAGE)
    verdict = (
        F.when((strip(F.col("title")) == "") | (F.length("title") > MOST_TITLE), "title_required")
        .when(lang("a") | lang("b"), "lang_required")
        .when(F.lower("a") == F.lower("b"), "same_language")
        .when(F.coalesce("n", F.lit(0)) == 0, "empty_paragraphs")
        .when(F.col("n") > MOST_PARAGRAPHS, "too_many_paragraphs")
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("translate") & F.col("filled"), "mixed_targets")
    )
    return out.select("doc_id", verdict.alias("verdict"))


def supported_params(params: DataFrame, models: DataFrame, seed: int = 7) -> DataFrame:
    """id, model, params: a map of parameters without what its model doesn't take; the seed is fixed where it takes one.

    params: id, model, params (map of text; reasoning by the keys reasoning.effort and reasoning.max_tokens). models: model, temperature, top_k, min_p, seed (booleans), reasoning ("effort",
    "max_tokens", "enable_thinking" or "none"). Of reasoning only what the model's kind names stays. An unknown model keeps all.
    """
    m = models.select(F.col("model"), *[F.col(c).alias(f"_{c}") for c in ("temperature", "top_k", "min_p", "seed", "reasoning")])
    j = params.join(m, "model", "left")
    known = F.col("_reasoning").isNotNull()
    drop = lambda k: known & F.coalesce(F.when(k == "temperature", ~F.col("_temperature")).when(k == "top_k", ~F.col("_top_k")).when(k == "min_p", ~F.col("_min_p")).when(k == "seed", F.lit(True)).when(k == "reasoning.effort", F.col("_reasoning") != "effort").when(k == "reasoning.max_tokens", F.col("_reasoning") != "max_tokens").when(k == "enable_thinking", F.col("_reasoning") != "enable_thinking"), F.lit(False))
    left = F.map_filter("params", lambda k, _: ~drop(k))
    fixed = F.when(known & F.col("_seed"), F.map_concat(left, F.create_map(F.lit("seed"), F.lit(str(seed))))).otherwise(left)
    return j.select("id", "model", fixed.alias("params"))

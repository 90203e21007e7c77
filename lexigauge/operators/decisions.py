"""Decisions over terms, issues, routes and jobs, and places in a whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classes of calendar entities, classes that never enter a corpus, and the first year that is too late for it.
CALENDAR = ("Q3186692", "Q39911", "Q578", "Q3311614", "Q29964144", "Q14795564", "Q18340514")
UNWANTED = ("Q11424", "Q3305213", "Q33506", "Q207694")
LATEST_YEAR = 500
# Parts of words that make an issue a major one, brackets that join a glyph to its neighbour.
MAJOR = ("incorrect", "wrong", "mistranslat", "error", "missing", "omit", "distort", "confus")
BRACKETS = "()[]{}⟨⟩«»<>"
# At which status a part of a job has ended.
ENDED, ENDED_PRECOMPUTE = ("done", "failed"), ("skipped", "stopped", "done")


def of_classes(classes: Column, listed: tuple[str, ...]) -> Column:
    """Whether one of the listed classes is among an entity's; false for null."""
    return F.coalesce(F.exists(classes, lambda c: c.isin(*listed)), F.lit(False))


def gated(classes: Column, year: Column) -> Column:
    """Whether the gate drops an entity: by class or by its least year. What is unknown stays."""
    return of_classes(classes, UNWANTED) | F.coalesce(year >= LATEST_YEAR, F.lit(False))


def severity(explanation: Column) -> Column:
    return F.when(F.lower(explanation).rlike("|".join(MAJOR)), "major").otherwise("minor")


def fragment(text: Column, pos: Column, surface: Column) -> Column:
    """Whether a surface of one character at pos (from 0) is glued to a letter, digit, mark or bracket."""
    glued = "[\\p{L}\\p{N}\\p{M}" + "".join("\\" + b if b in "()[]{}<>" else b for b in BRACKETS) + "]"
    before = F.when(pos > 0, F.substr(text, pos, F.lit(1))).otherwise("")
    after = F.substr(text, pos + 1 + F.length(surface), F.lit(1))
    return (F.length(F.trim(surface)) == 1) & (before.rlike(glued) | after.rlike(glued))


def badge(resolved_by: Column, no_trace: Column, qid: Column, n_candidates: Column) -> Column:
    """The tone of a term: det, llm, rej or none. The recorded way goes first, then what qid and candidates tell."""
    has_qid, some = F.coalesce(qid, F.lit("")) != "", n_candidates > 0
    known = F.when(resolved_by.isin("exact_label", "label_match"), "det").when(resolved_by == "llm_disambiguation", "llm")
    known = known.when(resolved_by.isin("llm_rejected", "ambiguous_candidates", "judge_unavailable"), "rej").when(resolved_by == "no_candidates", "none")
    known = known.otherwise(F.when(some, "rej").otherwise("none"))
    guess = F.when(has_qid & (n_candidates > 1), "llm").when(has_qid & (n_candidates == 1), "det").when(~has_qid & some, "rej").otherwise("none")
    bare = F.when(has_qid, "det").otherwise("none")
    return F.when(F.coalesce(resolved_by, F.lit("")) != "", known).when(no_trace, bare).otherwise(guess)


def group_summary(terms: DataFrame, group: str, order: str, tone: str) -> DataFrame:
    """Counts of groups, mentions and groups by the tone of their first term; no groups count 0."""
    g = terms.groupBy(group).agg(F.count("*").alias("n"), F.min_by(tone, order).alias("t"))
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_mentions"), F.count_if(F.col("t") == "det").alias("n_det"), F.count_if(F.col("t") == "llm").alias("n_llm"), F.count_if(F.col("t").isin("rej", "none")).alias("n_not_grounded"))


def score_band(score: Column) -> Column:
    return F.when(score >= 8, "green").when(score >= 6, "yellow").when(score.isNotNull(), "red")


def half_up(x: Column, places: int = 1) -> Column:
    """Rounding to the nearest, halves towards plus infinity."""
    return F.floor(x * 10**places + 0.5) / 10**places


def choose_route(stats: DataFrame, group: str) -> DataFrame:
    """Per group the live route of least (cost, latency, route), an unknown cost or latency last.

    stats: route, dead, n_success, success_rate, honest (null: no), cost, latency. Honest routes of a success rate of 0.9
    go first (relaxed 0), then honest ones (1), then any (2); a group without a live one has null in both columns.
    """
    live = ~F.col("dead") & (F.col("n_success") > 0)
    honest = F.coalesce("honest", F.lit(False))
    relaxed = F.when(honest & (F.col("success_rate") >= 0.9), 0).when(honest, 1).otherwise(2)
    far = F.lit(float("inf"))
    rank = F.struct(relaxed.alias("relaxed"), F.coalesce("cost", far).alias("c"), F.coalesce("latency", far).alias("l"), F.col("route"))
    best = stats.groupBy(group).agg(F.min(F.when(live, rank)).alias("_b"))
    return best.select(group, F.col("_b.route").alias("route"), F.col("_b.relaxed").alias("relaxed"))


def ended(translation: Column, precompute: Column, terms: Column) -> Column:
    """Whether nothing more can happen to a job; null is a part that the job doesn't have. A failed translation ends it."""
    on = translation.isNotNull() & ~translation.isin(*ENDED)
    waits = precompute.isNotNull() & ~precompute.isin(*ENDED_PRECOMPUTE)
    return F.when(on, False).when(translation == "failed", True).when(waits, False).otherwise(F.coalesce(terms.isin(*ENDED), F.lit(False)))


def succeeded(translation: Column, precompute: Column, terms: Column) -> Column:
    done = F.coalesce(translation, F.lit("done")) == "done"
    return done & (F.coalesce(precompute, F.lit("")) != "stopped") & F.coalesce(terms == "done", F.lit(False))


def enumerate_all(rows: DataFrame, doc: str, place: str, name: str, width: int = 1 << 16) -> DataFrame:
    """A running number from 0 over all rows by (doc, place), doc being a whole number.

    Rows are numbered inside their document; counts of documents are summed inside blocks of `width` ids and over the
    blocks, so the only window without a key has a row a block, and no task holds all rows or all documents.
    """
    block = F.floor(F.col(doc) / width).alias("_k")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    docs = rows.groupBy(doc).agg(F.count("*").alias("_n")).withColumn("_k", block)
    blocks = docs.groupBy("_k").agg(F.sum("_n").alias("_n")).withColumn("_b", before(Window.orderBy("_k"))).select("_k", "_b")
    docs = docs.withColumn("_a", before(Window.partitionBy("_k").orderBy(doc))).join(blocks, "_k").select(doc, (F.col("_a") + F.col("_b")).alias("_o"))
    own = F.row_number().over(Window.partitionBy(doc).orderBy(place)) - 1
    return rows.withColumn(name, own).join(docs, doc).withColumn(name, F.col(name) + F.col("_o")).drop("_o")


def route_stats(calls: DataFrame, group: list[str], padded_above: int = 100) -> DataFrame:
    """Success, latency, tokens, cost and verdict of each route.

    calls: ok, latency, prompt_tokens, completion_tokens, cost (null: not told), price_in and price_out (of a million
    tokens; null: no price), dead. Latencies are those of successful calls, of all calls when none was. The cost of a call
    is the median told one (real), else that of the median tokens by the prices (estimated), else unknown.
    """
    good = F.col("ok")
    med = lambda c: F.percentile(F.when(good, F.col(c)), F.lit(0.5))
    every = F.percentile("latency", F.lit(0.5))
    late = lambda x: F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {x})")
    a = calls.groupBy(*group).agg(
        F.count("*").alias("n_calls"), F.count_if(good).alias("n_success"), F.bool_or("dead").alias("dead"), F.coalesce(med("latency"), every).alias("latency_median"),
        F.coalesce(late("IF(ok, latency, NULL)"), late("latency")).alias("latency_p90"), med("prompt_tokens").alias("prompt_median"), med("completion_tokens").alias("completion_median"),
        med("cost").alias("_told"), F.max("price_in").alias("_in"), F.max("price_out").alias("_out"))
    told, guess = F.col("_told"), (F.col("prompt_median") * F.col("_in") + F.col("completion_median") * F.col("_out")) / 1_000_000
    rate, honest = F.col("n_success") / F.col("n_calls"), F.col("prompt_median") <= padded_above
    verdict = F.when(F.col("dead"), "dead").when(F.col("n_success") == 0, "failed").when(rate < 0.9, "unstable").when(~honest, "padded").when(honest, "candidate").otherwise("unknown-tokens")
    source = F.when(told.isNotNull(), "real").when(guess.isNotNull(), "estimated").otherwise("unknown")
    return a.select(*group, "n_calls", "n_success", rate.alias("success_rate"), "latency_median", "latency_p90", "prompt_median", "completion_median", F.coalesce(told, guess).alias("cost"), source.alias("cost_source"), honest.alias("honest"), "dead", verdict.alias("verdict"))

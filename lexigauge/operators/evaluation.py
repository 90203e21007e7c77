"""Scores of predictions against gold: by class, label and category, of grounding and of extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.operators import stats

COLOURS = ("green", "yellow", "red")


def _share(k: Column, n: Column, digits: int | None = None) -> Column:
    x = F.when(n > 0, k / n)
    return x if digits is None else F.round(x, digits)


def _units(rows: DataFrame) -> DataFrame:
    """Distinct (title, qid) with whether any, and whether all, of their surfaces start with a capital."""
    up = F.substring("surface", 1, 1).rlike(r"\p{Lu}")
    return rows.groupBy("title", "qid").agg(F.bool_or(up).alias("up"), F.bool_and(up).alias("all_up"))


def corpus(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Counts of distinct (title, qid) by class, named or term, and recall and precision with their intervals.

    gold has a tier; mentions of another tier than 0 are left out, and counted. Predictions are not filtered.
    """
    g, p = _units(gold.where("tier = 0")).withColumn("g", F.lit(True)), _units(pred).select("title", "qid", F.col("up").alias("p_up"))
    j = g.join(p, ["title", "qid"], "full_outer")
    has_g, has_p = F.col("g").isNotNull(), F.col("p_up").isNotNull()
    of = F.when(F.coalesce("up", "p_up"), "named").otherwise("term").alias("class")
    n = j.groupBy(of).agg(F.count_if(has_g & has_p).alias("tp"), F.count_if(has_g & ~has_p).alias("fn"), F.count_if(has_p & ~has_g).alias("fp"), F.count_if(F.col("up") & ~F.col("all_up")).alias("ambiguous"))
    both = gold.sparkSession.sql("SELECT * FROM VALUES ('named'), ('term') AS t(class)")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    n = both.join(n, "class", "left").select("class", *[zero(c) for c in ("tp", "fn", "fp", "ambiguous")])
    whole = n.agg(F.sum("ambiguous").alias("n_ambiguous")).crossJoin(gold.agg(F.count_if(F.col("tier") != 0).alias("n_dropped_by_tier")))  # one row
    found, said = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    n = n.crossJoin(F.broadcast(whole)).drop("ambiguous").withColumn("gold_units", found)
    for name, total in (("r_doc", found), ("p_doc", said)):
        low, high = stats.wilson(F.col("tp"), total)
        n = n.withColumns({name: _share(F.col("tp"), total), f"{name}_low": low, f"{name}_high": high, f"{name}_underpowered": total < 30})
    return n


def gold_counts(gold: DataFrame, excluded: DataFrame) -> DataFrame:
    """How many entities are left of gold without other tiers and excluded mentions, and how many mentions each takes."""
    who = ["title", "idx", "surface", "qid", "span"]
    out = gold.join(excluded.select(who).distinct().withColumn("out", F.lit(True)), who, "left")
    tier, gone = F.col("tier") != 0, F.col("out").isNotNull()
    return out.agg(F.count_distinct(F.when(~tier & ~gone, F.struct("title", "qid"))).alias("n_entities"), F.count_if(tier).alias("n_dropped_by_tier"), F.count_if(~tier & gone).alias("n_dropped_by_exclusion"))


def _counts(rows: DataFrame, truth: str, guess: str, labels, by=()) -> DataFrame:
    """tp, t and p of every label, from the counts of (truth, guess)."""
    n = rows.groupBy(*by, truth, guess).agg(F.count("*").alias("n"))
    n = n.withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    t, p = F.col(truth) == F.col("label"), F.col(guess) == F.col("label")
    return n.groupBy(*by, "label").agg(hit(t & p).alias("tp"), hit(t).alias("t"), hit(p).alias("p"))


def per_label(rows: DataFrame, truth: str, guess: str, labels) -> DataFrame:
    """Precision, recall and F1 of every label, 0 where undefined."""
    zero = lambda k, n: F.round(F.when(n > 0, k / n).otherwise(0.0), 4)
    tp, t, p = F.col("tp"), F.col("t"), F.col("p")
    return _counts(rows, truth, guess, labels).select("label", zero(tp, p).alias("precision"), zero(tp, t).alias("recall"), zero(2 * tp, t + p).alias("f1"))


def per_category(rows: DataFrame, category: str, truth: str, guess: str, labels) -> DataFrame:
    """Rows and macro F1, over the labels that occur, of every category; rows without one are `other`."""
    named = rows.withColumn("category", F.coalesce(F.col(category), F.lit("other")))
    c = _counts(named, truth, guess, labels, ["category"])
    f1 = F.when(F.col("t") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p")))
    return c.groupBy("category").agg(F.sum("t").alias("n"), F.round(F.avg(f1), 4).alias("macro_f1"))


def grounding(rows: DataFrame) -> DataFrame:
    """One row: sizes of the classes, accuracy of entities where one is due, coverage, accuracy on red, calls."""
    gold, pred = F.col("gold_difficulty"), F.col("pred_difficulty")
    due = gold.isin("green", "yellow")
    n = F.count("*")
    return rows.agg(
        n.alias("n"), *[F.count_if(gold == c).alias(f"n_{c}") for c in COLOURS],
        _share(F.count_if(due & (F.col("pred_qid") == F.col("gold_qid"))), F.count_if(due), 4).alias("qid_accuracy"),
        _share(F.count_if(pred.isin("green", "yellow")), n, 4).alias("coverage"),
        _share(F.count_if((gold == "red") & (pred == "red")), F.count_if(gold == "red"), 4).alias("red_accuracy"),
        F.round(F.avg("n_api_calls"), 2).alias("avg_api_calls"),
    )


def pairing(rows: DataFrame) -> DataFrame:
    """One row: terms that aren't red, nulls given for red ones, recommendations where the verdict is right and gold has one."""
    red = F.col("gold_difficulty") == "red"
    scope = ~red & (F.col("pred_pair") == F.col("gold_pair")) & (F.coalesce("gold_recommended", F.lit("")) != "")
    same = F.lower(F.trim(F.coalesce("pred_recommended", F.lit("")))) == F.lower(F.trim("gold_recommended"))
    return rows.agg(
        F.count_if(~red).alias("n_non_red"),
        _share(F.count_if(red & F.col("pred_pair").isNull()), F.count_if(red), 4).alias("null_accuracy"),
        _share(F.count_if(scope & same), F.count_if(scope), 4).alias("recommended_accuracy"),
        F.count_if(scope).alias("recommended_n"),
    )


def extraction(found: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    """Of every key, of sets of items: tp, sizes, precision, recall, F1 (0 where undefined), and the sorted items missed and spurious."""
    g, f = gold.select(key, item).distinct().withColumn("g", F.lit(True)), found.select(key, item).distinct().withColumn("f", F.lit(True))
    in_g, in_f = F.col("g").isNotNull(), F.col("f").isNotNull()
    c = g.join(f, [key, item], "full_outer").groupBy(key).agg(
        F.count_if(in_g & in_f).alias("tp"), F.count_if(in_f).alias("n_extracted"), F.count_if(in_g).alias("n_gold"),
        F.sort_array(F.collect_list(F.when(~in_f, F.col(item)))).alias("missed"), F.sort_array(F.collect_list(F.when(~in_g, F.col(item)))).alias("spurious"),
    )
    zero = lambda k, n: F.round(F.when(n > 0, k / n).otherwise(0.0), 4)
    return c.withColumns({"precision": zero(F.col("tp"), F.col("n_extracted")), "recall": zero(F.col("tp"), F.col("n_gold")), "f1": zero(2 * F.col("tp"), F.col("n_extracted") + F.col("n_gold"))})


def contamination(gold: DataFrame, pred: DataFrame, tainted: str) -> DataFrame:
    """Document-level recall with and without the predictions that came from a tainted source, in one row.

    gold: title, qid; pred: title, qid (null: nothing found), source (null counts as clean). Every gold row counts, repeats too.
    """
    found = pred.where("qid is not null").select("title", "qid", (~F.col("source").eqNullSafe(tainted)).alias("clean"))
    per = found.groupBy("title", "qid").agg(F.bool_or("clean").alias("clean"), F.lit(True).alias("hit"))
    n = gold.join(per, ["title", "qid"], "left").agg(F.count("*").alias("n_gold"), F.count("hit").alias("matched"), F.count_if("clean").alias("matched_clean"))
    p = found.agg(F.count("*").alias("n_grounded"), F.count_if(~F.col("clean")).alias("n_tainted"))
    out = n.crossJoin(F.broadcast(p))  # one row by one row
    full, clean = _share(F.col("matched"), F.col("n_gold"), 4), _share(F.col("matched_clean"), F.col("n_gold"), 4)
    delta = _share(F.col("matched_clean") - F.col("matched"), F.col("n_gold"), 4)
    return out.select("n_gold", "n_grounded", "n_tainted", _share(F.col("n_tainted"), F.col("n_grounded"), 4).alias("tainted_share"), "matched", "matched_clean", full.alias("recall"), clean.alias("recall_clean"), delta.alias("delta"), (F.col("matched") - F.col("matched_clean")).alias("n_lost"))


def residuals(cells: DataFrame, targets: DataFrame, keys: list[str], value: str = "rho") -> DataFrame:
    """cells joined to their targets (keys, target): target, computed and residual, four places."""
    j = cells.join(targets, keys)
    return j.select(*keys, "target", F.col(value).alias("computed"), F.round(F.col(value) - F.col("target"), 4).alias("residual"))


def nearest(res: DataFrame, by: str) -> DataFrame:
    """The mean absolute residual of each variant, and whether it is the least (the first by name of equal ones)."""
    m = res.groupBy(by).agg(F.round(F.avg(F.abs(F.col("computed") - F.col("target"))), 4).alias("mean_abs"))
    best = m.agg(F.min(F.struct("mean_abs", by)).alias("_b"))
    return m.crossJoin(F.broadcast(best)).select(by, "mean_abs", (F.col(by) == F.col(f"_b.{by}")).alias("best"))  # one row

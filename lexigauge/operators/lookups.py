"""Lookups with an order of precedence: contexts of mentions, entities of titles, checked verdicts, parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.operators import shaping

#: Characters of a paragraph on either side of a surface found in it.
MARGIN = 40
# The parameters that a model may be given, and the least and greatest of each.
RANGES = {"max_tokens": (1, 32768), "temperature": (0, 2), "top_p": (0, 1), "top_k": (None, None), "min_p": (None, None), "seed": (None, None)}
WHOLE = ("max_tokens", "top_k", "seed")
EFFORTS = ("low", "medium", "high")


def contexts(mentions: DataFrame, known: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """mentions with context, origin, start and end.

    mentions: surface, lemma, context, para, start, end, and norm_surface and norm_lemma as keys of `known` (norm, context;
    one row a norm). The mention's own context comes first (golden), then a known one by surface or lemma
    (golden_source), then what stands round the surface in its paragraph (para, source: reconstructed), else none
    (unavailable). Empty contexts count as none; missing places are -1.
    """
    some = known.where("context <> ''")
    of = lambda name: some.select(F.col("norm").alias(f"norm_{name}"), F.col("context").alias(f"_{name}"))
    m = mentions.join(of("surface"), "norm_surface", "left").join(of("lemma"), "norm_lemma", "left").join(paragraphs.select("para", F.col("source").alias("_source")), "para", "left")
    own, found = F.nullif("context", F.lit("")), F.coalesce("_surface", "_lemma")
    source, n = F.coalesce("_source", F.lit("")), F.length("surface")
    at = F.position(F.col("surface"), source)
    left = F.greatest(F.lit(1), at - MARGIN)
    around = F.substr(source, left, at - left + n + MARGIN)
    hit = at > 0
    place = lambda given, here: F.when(own.isNotNull() | found.isNotNull(), F.coalesce(given, F.lit(-1))).when(hit, here).otherwise(-1)
    origin = F.when(own.isNotNull(), "golden").when(found.isNotNull(), "golden_source").when(hit, "reconstructed").otherwise("unavailable")
    text = F.coalesce(own, found, F.when(hit, around), F.lit(""))
    return m.withColumns({"context": text, "origin": origin, "start": place(F.col("start"), at - 1), "end": place(F.col("end"), at - 1 + n)}).drop("_surface", "_lemma", "_source")


def entities_of(titles: DataFrame, normalized: DataFrame, redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """(title, state, canonical, qid): titles normalised (src, dst), redirects followed, then looked up among pages.

    pages: canonical, qid (null: none), missing. state is entity, no_entity for a page without one, or missing, which
    has null in the other columns. Each distinct title gives one row.
    """
    t = titles.select("title").distinct().join(normalized.select(F.col("src").alias("title"), F.col("dst").alias("_to")), "title", "left")
    t = t.select(F.col("title").alias("asked"), F.coalesce("_to", "title").alias("title"))
    ends = shaping.redirect_chain(t.select("title").distinct(), redirects).select("title", F.col("target").alias("canonical"))
    there = pages.where("not missing").select("canonical", "qid", F.lit(True).alias("_there"))
    out = t.join(ends, "title").join(there, "canonical", "left")
    known = F.col("_there").isNotNull()
    state = F.when(~known, "missing").when(F.col("qid").isNull(), "no_entity").otherwise("entity")
    return out.select(F.col("asked").alias("title"), state.alias("state"), F.when(known, F.col("canonical")).alias("canonical"), "qid")


def overlaid(terms: DataFrame, checked: DataFrame) -> DataFrame:
    """terms (surface, target, verdict, recommended) with the fields of a checked row (one a surface) that has a verdict.

    A checked verdict brings its own target and recommendation, null ones too.
    """
    c = checked.where("verdict <> ''").select("surface", F.struct("target", "verdict", "recommended").alias("_c"))
    out = terms.join(c, "surface", "left")
    given = F.col("_c").isNotNull()
    return out.withColumns({f: F.when(given, F.col(f"_c.{f}")).otherwise(F.col(f)) for f in ("target", "verdict", "recommended")}).drop("_c")


def first_bad_parameter(params: Column) -> Column:
    """The least name of a parameter that is unknown or out of its range; null for none. params: names to JSON values."""

    def number(v, whole):
        return v.rlike(r"^-?\d+$" if whole else r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")

    def fits(k, v):
        out = F.lit(False)
        for name, (low, high) in RANGES.items():
            x = v.try_cast("double")
            ok = number(v, name in WHOLE)
            if low is not None:
                ok = ok & F.coalesce(x.between(low, high), F.lit(False))
            out = F.when(k == name, ok).otherwise(out)
        out = F.when(k == "enable_thinking", v.isin("true", "false")).otherwise(out)
        effort, most = F.get_json_object(v, "$.effort"), F.get_json_object(v, "$.max_tokens")
        keys = F.json_object_keys(v)
        fine = F.coalesce(F.size(F.array_except(keys, F.array(F.lit("effort"), F.lit("max_tokens")))) == 0, F.lit(False))
        fine = fine & (effort.isNull() | effort.isin(*EFFORTS)) & (most.isNull() | most.rlike(r"^\d+$"))
        return F.coalesce(F.when(k == "reasoning", fine).otherwise(out), F.lit(False))

    return F.array_min(F.map_keys(F.map_filter(params, lambda k, v: ~fits(k, v))))

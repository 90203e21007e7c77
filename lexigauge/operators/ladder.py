"""Grounding of mentions: a ladder of searches that only unresolved mentions climb, exact names, judged choices.

Searches are answers kept in a table: an answer with hits, an empty one, or none at all because nobody asked. Mentions of
equal surface, lemma, alternates and guesses climb once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.functions import forms
from lexigauge.functions.text import norm
from lexigauge.operators.cuts import cut

# Mechanisms of search, and what a source, a tier and a reason are called.
PREFIX, FULL_TEXT, PAGE = "wbsearchentities", "cirrus", "wikipedia_wikibase_item"
NO_SOURCE, PAGE_SOURCE, UNKNOWN = "none", "wikipedia_langlink", "unknown"
# Words in descriptions that rule an entity out, always or for a place, and those of which it needs one.
FICTION = ("персонаж", "мультф", "комикс", "вымышлен", "fictional", "cartoon", "comic")
DISAMBIGUATION = ("disambiguation", "страница значений")
PERSON = ("ruler", "priest", "king ", "queen ", "politician", "footballer", "born ", "died ", "president", "emperor", "monarch", "bishop", "pope", "poet", "singer", "writer", "painter", "actor", "actress")
PLAUSIBLE = (
    "археолог", "истори", "древн", "мифол", "бог", "богин", "импери", "царь", "короле", "правител", "город", "рек", "государств", "цивилизац",
    "период", "династ", "культур", "месопотам", "шумер", "вавилон", "ассири", "аккад", "семит", "клинопис", "храм",
    "archaeolog", "histor", "ancient", "myth", "god", "goddess", "empire", "king", "ruler", "river", "civiliz", "period", "dynast", "culture",
    "mesopotam", "sumer", "babylon", "assyria", "akkad", "semitic", "temple", "cuneiform", "near east",
)
HIT = "array<struct<id:string,tier:string>>"
QUERY = "array<struct<q:string,kind:string,mechanism:string,n_hits:int>>"


@dataclass(frozen=True)
class Config:
    """Which rungs are open; widen: "baseline", "alt-names" or "label-guess"; hits of a search and candidates at most."""

    use_lemma: bool = True
    use_full_text: bool = True
    use_page: bool = True
    widen: str = "baseline"
    search_limit: int = 7
    enrich_top: int = 5
    match_aliases: bool = True


def implausible(description: Column, domain: Column) -> Column:
    """A description of fiction or of a list of meanings, of a person for a place, or of nothing that fits the subject."""
    d = F.lower(F.coalesce(description, F.lit("")))
    has = lambda words: F.greatest(*[d.contains(w) for w in words])
    return has(FICTION) | has(DISAMBIGUATION) | (F.coalesce(domain == "place", F.lit(False)) & has(PERSON)) | ~has(PLAUSIBLE)


def _asked(words: list[Column], kinds: list[Column]) -> Column:
    """The different words that aren't empty, in order, with their kinds."""
    rows = F.array(*[F.struct(F.coalesce(w, F.lit("")).alias("q"), k.alias("kind")) for w, k in zip(words, kinds)])
    rows = F.filter(rows, lambda r: r["q"] != "")
    return F.filter(rows, lambda r, i: F.array_position(F.transform(rows, lambda x: x["q"]), r["q"]) == i + 1)


def _climbed(state: DataFrame, answers: DataFrame, rungs: list[tuple[Column, str, str, str, int]]) -> DataFrame:
    """state with hits, queries and source: those of the first rung with a hit or with a word that was never asked.

    rungs: words asked, mechanism, source, tier, most hits of a word. All rungs' words meet the answers in one join, as answers
    are a table; what a rung above the one that settles a mention asks is left out again. Each id counts once, by the word's
    place and the hit's rank. Keys meet their few words in one grouping, so the table is dealt twice in all.
    """

    def listed(r, asked, mechanism, most):
        return F.transform(asked, lambda w, i: F.struct(F.lit(r).alias("rung"), i.alias("place"), w["q"].alias("q"), w["kind"].alias("kind"), F.lit(mechanism).alias("mechanism"), F.lit(most).alias("most")))

    ask = [listed(r, asked, mechanism, most) for r, (asked, mechanism, _, _, most) in enumerate(rungs)]
    words = state.select("key", F.explode(F.concat(*ask)).alias("a")).select("key", "a.*")
    got = words.join(answers.select("mechanism", "q", "hits"), ["mechanism", "q"], "left").withColumn("ids", F.slice("hits", 1, F.col("most")))
    query = F.struct("q", "kind", "mechanism", F.coalesce(F.size("ids"), F.lit(0)).alias("n_hits")).cast("struct<q:string,kind:string,mechanism:string,n_hits:int>")
    told = F.struct("rung", "place", query.alias("query"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    ends = F.col("ids").isNull() | (F.size("ids") > 0)
    of = got.groupBy("key").agg(F.sort_array(F.collect_list(told)).alias("got"), F.min(F.when(ends, F.col("rung"))).alias("stop"), F.collect_set(F.when(F.col("ids").isNull(), F.col("rung"))).alias("never"))  # a few words a mention
    out = state.select("key").join(of, "key", "left")
    stop = F.col("stop")
    unknown = F.coalesce(F.array_contains("never", stop), F.lit(False))
    ids = F.array_distinct(F.flatten(F.transform(F.filter("got", lambda g: g["rung"] == stop), lambda g: g["ids"])))
    at = lambda names: F.element_at(F.array(*map(F.lit, names)), stop + 1)
    hits = F.transform(ids, lambda i: F.struct(i.alias("id"), at([r[3] for r in rungs]).alias("tier"))).cast(HIT)
    asked = F.transform(F.filter("got", lambda g: stop.isNull() | (g["rung"] <= stop)), lambda g: g["query"]).cast(QUERY)
    return out.select(
        "key",
        F.when(unknown, UNKNOWN).when(stop.isNotNull(), at([r[2] for r in rungs])).otherwise(NO_SOURCE).alias("source"),
        F.coalesce(asked, F.array().cast(QUERY)).alias("queries"),
        F.when(stop.isNotNull() & ~unknown, hits).otherwise(F.array().cast(HIT)).alias("hits"),
    )


def candidates(mentions: DataFrame, answers: DataFrame, entities: DataFrame, guesses: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """One row per mention: mention_id, surface, lemma, source, n_hits, queries, candidates.

    mentions: mention_id (unique), surface, lemma, context; nulls count as empty. answers: mechanism, q, hits (ids by rank, an
    empty array for a search without a hit); a search that isn't there was never asked, its mention ends as "unknown".
    entities: id (as asked), qid (what it redirects to), label_ru, label_en, description, aliases_ru, aliases_en.
    guesses: mention_id, label_ru, label_en.

    Rungs: lemma and surface by prefix, both in full text, the page of the lemma or else the surface, then (if asked for)
    alternates behind the surface and guessed labels by prefix. A rung is searched only for what earlier ones left with nothing.
    Candidates are the first hits that are entities, under the ids they redirect to.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    m = mentions.repartition("mention_id").select("mention_id", text("surface").alias("surface"), text("lemma").alias("lemma"), text("context").alias("context"))
    m = m.withColumn("alts", forms.alternates(F.col("surface"), F.col("context")) if config.widen != "baseline" else none).drop("context")
    if guesses is not None and config.widen == "label-guess":
        m = m.join(guesses.select("mention_id", F.array(text("label_ru"), text("label_en")).alias("guessed")), "mention_id", "left").withColumn("guessed", F.coalesce("guessed", none))
    else:
        m = m.withColumn("guessed", none)
    same = ["surface", "lemma", "alts", "guessed"]
    m = cut(m.withColumn("key", F.sha2(F.to_json(F.struct(*same)), 256)))
    state = m.groupBy("key").agg(*[F.first(c).alias(c) for c in same])
    lemma, surface = F.col("lemma"), F.col("surface")
    kind = lambda q: F.when((q == lemma) & (lemma != ""), "lemma").otherwise("surface")
    shapes = _asked([lemma, surface], [F.lit("lemma"), kind(surface)]) if config.use_lemma else _asked([surface], [kind(surface)])
    page = F.when(lemma != "", lemma).otherwise(surface)
    listed = lambda c, tier: F.transform(F.filter(c, lambda q: q != ""), lambda q: F.struct(q.alias("q"), F.lit(tier).alias("kind")))
    rungs = [(shapes, PREFIX, PREFIX, "baseline")]
    rungs += [(shapes, FULL_TEXT, FULL_TEXT, "baseline")] if config.use_full_text else []
    rungs += [(_asked([page], [kind(page)]), PAGE, PAGE_SOURCE, "baseline")] if config.use_page else []
    rungs += [(listed("alts", "alt"), PREFIX, "alt", "alt")] if config.widen != "baseline" else []
    rungs += [(listed("guessed", "label_guess"), PREFIX, "label_guess", "label_guess")] if config.widen == "label-guess" else []
    every = cut(_climbed(state, answers, [(*r, 1 if r[1] == PAGE else config.search_limit) for r in rungs]))
    every = every.select("key", "source", F.size("hits").alias("n_hits"), "queries", "hits")
    top = every.select("key", F.posexplode(F.slice("hits", 1, config.enrich_top)).alias("place", "hit")).select("key", "place", F.col("hit.id").alias("id"), F.col("hit.tier").alias("tier"))
    fields = ["qid", "label_ru", "label_en", "description", "aliases_ru", "aliases_en"]
    found = top.join(entities.select("id", *fields), "id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", *fields, "tier"))).alias("candidates"))
    empty = F.array().cast(found.schema["candidates"].dataType)
    out = m.select("mention_id", "surface", "lemma", "key").join(every.drop("hits").join(found, "key", "left"), "key")
    return cut(out.withColumn("candidates", F.coalesce("candidates", empty)).drop("key"))  # callers read it several times


def exact_matches(found: DataFrame, match_aliases: bool = True) -> DataFrame:
    """(mention_id, place, qid, kind, value, query): candidates with a name equal to the lemma or the surface under `norm`.

    Per candidate its label counts before aliases, Russian aliases before English ones, each in order, the lemma before the surface.
    """
    lists = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    each = found.select("mention_id", "surface", "lemma", F.explode("candidates").alias("c")).select("mention_id", "surface", "lemma", "c.*")
    named = lambda kind, c: F.transform(lists(c), lambda v: F.struct(F.lit(kind).alias("rank"), v.alias("value")))
    names = [named(0, F.array("label_ru"))] + ([named(1, F.col("aliases_ru")), named(2, F.col("aliases_en"))] if match_aliases else [])
    each = each.select("mention_id", "place", "qid", "lemma", "surface", F.posexplode(F.concat(*names)).alias("at", "n")).where("n.value <> ''")
    each = each.select("mention_id", "place", "qid", "at", "n.rank", "n.value", F.posexplode(F.array("lemma", "surface")).alias("order", "query")).where("query <> ''")
    hit = each.where(norm(F.col("value")).eqNullSafe(norm(F.col("query"))))  # neither is null; a test for it would fold all names once more
    best = hit.groupBy("mention_id", "place", "qid").agg(F.min(F.struct("rank", "at", "order", "value", "query")).alias("b"))
    kind = F.element_at(F.array(F.lit("label_ru"), F.lit("alias_ru"), F.lit("alias_en")), F.col("b.rank") + 1)
    return best.select("mention_id", "place", "qid", kind.alias("kind"), "b.value", "b.query")


def grounded(found: DataFrame, decisions: DataFrame, scope: Column, match_aliases: bool = True) -> DataFrame:
    """mention_id, source, resolved_by, difficulty, chosen, n_candidates, n_exact of mentions with their candidates.

    One exact name settles a mention (green). Otherwise the judge's decision for its scope, its folded lemma or surface and
    its candidates' ids counts. decisions: scope, term, ids (sorted), answered, qid. No decision or an unanswered one, or an
    id that isn't a candidate: judge_unavailable, yellow; a null id: judge_rejected, red; else llm_disambiguation, yellow.
    Without candidates a mention is red; "unknown" if a search of it was never asked.
    """
    exact = exact_matches(found, match_aliases).groupBy("mention_id").agg(F.count("*").alias("n_exact"), F.min(F.struct("place", "qid"))["qid"].alias("exact"))
    ids = F.sort_array(F.transform("candidates", lambda c: c["qid"]))
    term = norm(F.when(F.col("lemma") != "", F.col("lemma")).otherwise(F.col("surface")))
    rows = found.select("mention_id", "source", scope.alias("scope"), term.alias("term"), ids.alias("ids")).join(exact, "mention_id", "left")
    said = decisions.select("scope", "term", "ids", F.col("answered"), F.col("qid").alias("said"))
    rows = rows.join(said, ["scope", "term", "ids"], "left")
    n = F.size("ids")
    one, answered = F.col("n_exact") == 1, F.coalesce("answered", F.lit(False))
    by = F.when((n == 0) & (F.col("source") == UNKNOWN), UNKNOWN).when(n == 0, "no_candidates").when(one, "exact_label").when(~answered, "judge_unavailable").when(F.col("said").isNull(), "judge_rejected").when(~F.array_contains("ids", F.coalesce("said", F.lit(""))), "judge_unavailable").otherwise("llm_disambiguation")
    rows = rows.withColumn("resolved_by", by)
    colour = F.when(F.col("resolved_by") == "exact_label", "green").when(F.col("resolved_by").isin("judge_unavailable", "llm_disambiguation"), "yellow").when(F.col("resolved_by") != UNKNOWN, "red")
    chosen = F.when(F.col("resolved_by") == "exact_label", F.col("exact")).when(F.col("resolved_by") == "llm_disambiguation", F.col("said"))
    return rows.select("mention_id", "source", "resolved_by", colour.alias("difficulty"), chosen.alias("chosen"), n.alias("n_candidates"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"))


def enriched(mentions: DataFrame, answers: DataFrame, entities: DataFrame, domain: DataFrame, most: int = 4) -> DataFrame:
    """mention_id, resolved_by, chosen, pool: surfaces by prefix alone, exact names that are plausible for their domain.

    domain: mention_id, domain. One such name settles it (exact_label); none or several are ambiguous_candidates; without a hit
    no_candidates. The pool holds exact ones first, then the others by rank, each id once, `most` at most.
    """
    found = candidates(mentions.withColumn("lemma", F.lit("")), answers, entities, config=Config(use_lemma=False, use_full_text=False, use_page=False, enrich_top=7))
    exact = exact_matches(found)
    each = found.select("mention_id", "source", F.explode_outer("candidates").alias("c")).select("mention_id", "source", "c.place", "c.qid", "c.description")
    each = each.join(exact.where("kind <> 'alias_en'").select("mention_id", "place", F.lit(True).alias("same")), ["mention_id", "place"], "left").join(domain.select("mention_id", "domain"), "mention_id", "left")
    good = F.coalesce("same", F.lit(False)) & ~implausible(F.col("description"), F.col("domain"))
    each = each.withColumn("exact", good)
    first = Window.partitionBy("mention_id", "qid").orderBy(F.desc("exact"), "place")
    each = each.withColumn("again", F.row_number().over(first))
    entry = F.when(F.col("qid").isNotNull() & (F.col("again") == 1), F.struct((~F.col("exact")).alias("later"), "place", "qid"))
    of = each.groupBy("mention_id").agg(F.sort_array(F.collect_list(entry)).alias("pool"), F.count_if("exact").alias("n"), F.min(F.when(F.col("exact"), F.col("qid"))).alias("one"), F.count("qid").alias("hits"))
    by = F.when(F.col("hits") == 0, "no_candidates").when(F.col("n") == 1, "exact_label").otherwise("ambiguous_candidates")
    return of.select("mention_id", by.alias("resolved_by"), F.when(F.col("n") == 1, F.col("one")).alias("chosen"), F.transform(F.slice("pool", 1, most), lambda p: p["qid"]).alias("pool"))

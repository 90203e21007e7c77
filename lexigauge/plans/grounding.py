"""Queries of term grounding: places of rows, the search ladder, names that hold each other, lemmas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigauge.operators import ladder, location
from lexigauge.plans.registry import query
from lexigauge.sources.tables import table

ROWS = ("""CASE WHEN doc_id % 4 = 0 THEN doc_id ELSE -1 - doc_id END AS paragraph_id""", """CASE WHEN doc_id % 4 = 1 THEN '  ' || substr(text, 11, 90) || ' ' WHEN doc_id % 4 = 2 THEN 'no such context ' || doc_id ELSE NULL END AS context""", """CASE WHEN doc_id % 8 = 3 THEN reverse(substr(text, 1, 9)) ELSE substr(text, 1, 4 + doc_id % 9) END AS surface""")


@query(f"""WITH r AS (SELECT doc_id AS id, {", ".join(ROWS)} FROM documents), o AS (SELECT r.*, d.doc_id AS own FROM r LEFT JOIN documents d ON r.paragraph_id = d.doc_id),
q AS (SELECT *, CASE WHEN own IS NULL THEN substr(trim(context, ' ' || chr(9) || chr(10)), 1, 60) END AS probe, CASE WHEN own IS NULL THEN substr(surface, 1, greatest(4, length(surface) - 2)) END AS stem FROM o),
n AS (SELECT probe AS needle FROM q WHERE probe <> '' UNION SELECT stem FROM q), f AS (SELECT needle, min(doc_id) AS at FROM n JOIN documents ON contains(text, needle) GROUP BY 1)
SELECT id, coalesce(own, a.at, b.at) AS located, CASE WHEN own IS NOT NULL THEN 'own' WHEN a.at IS NOT NULL THEN 'context' WHEN b.at IS NOT NULL THEN 'surface' END AS rule FROM q LEFT JOIN f a ON probe = a.needle LEFT JOIN f b ON stem = b.needle""")
def paragraph_location(s, d):
    docs = table(s, d, "documents")
    rows = docs.selectExpr("doc_id AS id", *ROWS)
    out = location.located(rows, docs.select(F.col("doc_id").alias("paragraph_id"), F.col("doc_id").alias("place"), F.col("text").alias("source")))
    return out.select("id", "located", "rule")


@query("""WITH a AS (SELECT DISTINCT substr(p_name, 1, 4 + p_partkey % 5) AS name FROM part), b AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT p_type FROM part)
SELECT a.name AS "left", b.name AS "right" FROM a, b WHERE a.name <> '' AND b.name <> '' AND (contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)))""")
def label_containment(s, d):
    p = table(s, d, "part")
    return location.either_way(p.selectExpr("substr(p_name, 1, 4 + p_partkey % 5) AS name"), p.selectExpr("upper(p_name) AS name").union(p.select("p_type")))


@query("""WITH w AS (SELECT conv_id * 100 + turn AS place, split_part(text, ' ', 1) AS surface, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN '' ELSE lower(split_part(text, ' ', 1)) END AS lemma, text AS context FROM conversations),
f AS (SELECT surface, arg_min(context, place) AS context FROM w GROUP BY 1), l AS (SELECT split_part(text, ' ', 1) AS surface, min(lower(substr(text, 1, 3))) AS lemma FROM conversations WHERE conv_id % 2 = 0 AND substr(text, 1, 3) <> '' GROUP BY 1)
SELECT w.place, surface, coalesce(l.lemma, w.lemma, surface) AS lemma, f.context, w.lemma IS DISTINCT FROM coalesce(l.lemma, w.lemma, surface) AS changed FROM w JOIN f USING (surface) LEFT JOIN l USING (surface)""")
def lemma_corrections(s, d):
    c = table(s, d, "conversations")
    word = F.split_part("text", F.lit(" "), F.lit(1))
    lemma = F.when(F.col("turn") % 3 == 1, "").when(F.col("turn") % 3 == 2, F.lower(word))
    mentions = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("place"), word.alias("surface"), lemma.alias("lemma"), F.col("text").alias("context"))
    return location.relabelled(mentions, c.where("conv_id % 2 = 0").select(word.alias("surface"), F.lower(F.substring("text", 1, 3)).alias("lemma")))


# Mentions of parts in seven groups, by the rung that has their hits: prefix, full text, page, alternates, guesses, none, never asked.
MENTIONS = ("p_partkey AS k", "p_partkey % 7 AS c", "'P' || p_partkey || ' ' || p_name AS surface", "CASE WHEN p_partkey % 2 = 0 THEN lower('P' || p_partkey || ' ' || p_name) ELSE '' END AS lemma", "p_brand || '-' || p_partkey AS alt1", "p_type || '-' || p_partkey AS alt2", "CASE WHEN p_partkey % 7 = 4 THEN 'G' || p_partkey ELSE '' END AS g1", "'H' || p_partkey AS g2")
ASKED = (
    ("wbsearchentities", "surface", "c <> 6", "CASE WHEN c = 0 THEN 1 + k % 9 ELSE 0 END"),
    ("wbsearchentities", "lower(surface)", "c <> 6", "CASE WHEN c = 0 THEN k % 3 ELSE 0 END"),
    ("cirrus", "surface", "c BETWEEN 1 AND 5", "CASE WHEN c = 1 THEN 2 + k % 4 ELSE 0 END"),
    ("cirrus", "lower(surface)", "c BETWEEN 1 AND 5", "CASE WHEN c = 1 THEN 1 ELSE 0 END"),
    ("wikipedia_wikibase_item", "CASE WHEN lemma <> '' THEN lemma ELSE surface END", "c BETWEEN 2 AND 5", "CASE WHEN c = 2 THEN 1 ELSE 0 END"),
    ("wbsearchentities", "alt1", "c BETWEEN 3 AND 5", "CASE WHEN c = 3 THEN 2 ELSE 0 END"),
    ("wbsearchentities", "alt2", "c BETWEEN 3 AND 5", "CASE WHEN c = 3 THEN 1 ELSE 0 END"),
    ("wbsearchentities", "g1", "c = 4", "1"),
    ("wbsearchentities", "g2", "c BETWEEN 4 AND 5", "CASE WHEN c = 4 THEN 2 ELSE 0 END"),
)
HIT_ID = "CASE WHEN r = 1 AND k % 5 = 0 THEN 'E' || k WHEN r = 2 AND k % 15 = 0 THEN 'F' || k ELSE 'Q' || ((k * 3 + r * 5 + length(q)) % 150) END"
ENTITY_QID = "CASE WHEN j % 10 = 8 THEN 'Q' || (j - 1) ELSE 'Q' || j END"
ASKED_SQL = " UNION ALL ".join(f"SELECT '{mech}' AS mech, {q} AS q, {n} AS n, k FROM m WHERE {when}" for mech, q, when, n in ASKED)
LADDER = f"""m AS (SELECT {", ".join(MENTIONS)} FROM part), asked AS ({ASKED_SQL}),
w AS (SELECT k, 1 AS rung, 0 AS ord, lemma AS q, '{ASKED[0][0]}' AS mech FROM m UNION ALL SELECT k, 1, 1, surface, '{ASKED[0][0]}' FROM m UNION ALL SELECT k, 2, 0, lemma, '{ASKED[2][0]}' FROM m UNION ALL SELECT k, 2, 1, surface, '{ASKED[2][0]}' FROM m
UNION ALL SELECT k, 3, 0, CASE WHEN lemma <> '' THEN lemma ELSE surface END, '{ASKED[4][0]}' FROM m UNION ALL SELECT k, 4, 0, alt1, '{ASKED[0][0]}' FROM m UNION ALL SELECT k, 4, 1, alt2, '{ASKED[0][0]}' FROM m UNION ALL SELECT k, 5, 0, g1, '{ASKED[0][0]}' FROM m UNION ALL SELECT k, 5, 1, g2, '{ASKED[0][0]}' FROM m),
a AS (SELECT w.k, rung, ord, w.q, asked.k AS of, CASE WHEN n > 7 THEN 7 ELSE n END AS n FROM w LEFT JOIN asked ON w.mech = asked.mech AND w.q = asked.q WHERE w.q <> ''),
s AS (SELECT k, rung, bool_or(n IS NULL) AS never, sum(coalesce(n, 0)) AS n FROM a GROUP BY 1, 2), best AS (SELECT k, min(rung) AS rung, arg_min(never, rung) AS never FROM s WHERE never OR n > 0 GROUP BY 1),
h AS (SELECT k, rung, ord, r, {HIT_ID.replace(" k ", " of ").replace("|| k", "|| of").replace("(k ", "(of ")} AS id FROM (SELECT a.*, unnest(range(1, n + 1)) AS r FROM a JOIN best USING (k, rung) WHERE NOT never)),
u AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY ord, r) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY ord, r) AS again FROM h) WHERE again = 1),
ent AS (SELECT 'Q' || j AS id, {ENTITY_QID} AS qid, 'label ' || j AS label_ru, NULL AS alias_en, CASE WHEN j % 3 = 0 THEN 'Ancient city' ELSE 'A comic of a river' END AS description FROM (SELECT DISTINCT p_partkey % 150 AS j FROM part) WHERE j % 10 <> 9
UNION ALL SELECT 'E' || k, 'E' || k, upper(surface), NULL, CASE WHEN k % 2 = 0 THEN 'a river' ELSE 'ruler of Sumer' END FROM m UNION ALL SELECT 'F' || k, 'F' || k, 'other', surface, 'a temple' FROM m),
cand AS (SELECT u.k, place, qid, lower(label_ru) = lower(surface) OR coalesce(lower(alias_en) = lower(surface), false) AS exact, description FROM u JOIN ent USING (id) JOIN m ON m.k = u.k WHERE place < 5),
per AS (SELECT k, count(*) AS n_candidates, count(*) FILTER (exact) AS n_exact, min(qid) FILTER (exact) AS the_exact, arg_min(qid, place) AS first, list(qid ORDER BY place) AS qids FROM cand GROUP BY 1),
src AS (SELECT m.k, CASE WHEN best.rung IS NULL THEN 'none' WHEN never THEN 'unknown' ELSE ['wbsearchentities', 'cirrus', 'wikipedia_langlink', 'alt', 'label_guess'][best.rung] END AS source FROM m LEFT JOIN best USING (k))"""


def _ladder(s, d):
    m = table(s, d, "part").selectExpr(*MENTIONS)
    rows = None
    for mech, q, when, n in ASKED:
        part = m.where(when).selectExpr(f"'{mech}' AS mechanism", f"{q} AS q", f"{n} AS n", "k")
        rows = part if rows is None else rows.union(part)
    hits = rows.selectExpr("mechanism", "q", f"CASE WHEN n > 0 THEN transform(sequence(1, n), r -> {HIT_ID}) ELSE cast(array() AS array<string>) END AS hits")
    context = F.concat("surface", F.lit(" ("), "alt1", F.lit(", "), "alt2", F.lit(") was sold"))
    mentions = m.select(F.col("k").alias("mention_id"), "surface", "lemma", context.alias("context"))
    j = table(s, d, "part").selectExpr("p_partkey % 150 AS j").distinct().where("j % 10 <> 9")
    none = "cast(array() AS array<string>)"
    ent = j.selectExpr("'Q' || j AS id", f"{ENTITY_QID} AS qid", "'label ' || j AS label_ru", "cast(NULL AS string) AS label_en", "CASE WHEN j % 3 = 0 THEN 'Ancient city' ELSE 'A comic of a river' END AS description", f"{none} AS aliases_ru", f"{none} AS aliases_en")
    ent = ent.union(m.selectExpr("'E' || k", "'E' || k", "upper(surface)", "NULL", "CASE WHEN k % 2 = 0 THEN 'a river' ELSE 'ruler of Sumer' END", none, none)).union(m.selectExpr("'F' || k", "'F' || k", "'other'", "NULL", "'a temple'", none, "array(surface)"))
    guesses = m.selectExpr("k AS mention_id", "g1 AS label_ru", "g2 AS label_en")
    return mentions, hits, ent, guesses


@query(f"WITH {LADDER} SELECT src.k AS mention_id, source, CASE WHEN source IN ('none', 'unknown') THEN 0 ELSE (SELECT count(*) FROM u WHERE u.k = src.k) END AS n_hits, coalesce(array_to_string(qids, ','), '') AS qids FROM src LEFT JOIN per ON per.k = src.k")
def search_ladder(s, d):
    mentions, answers, entities, guesses = _ladder(s, d)
    out = ladder.candidates(mentions, answers, entities, guesses, ladder.Config(widen="label-guess"))
    return out.select("mention_id", "source", "n_hits", F.array_join(F.transform("candidates", lambda c: c["qid"]), ",").alias("qids"))


@query(f"""WITH {LADDER}, f AS (SELECT src.k, CASE WHEN source = 'unknown' THEN 'unknown' WHEN n_candidates IS NULL THEN 'no_candidates' WHEN n_exact = 1 THEN 'exact_label' WHEN src.k % 4 = 0 OR src.k % 4 = 3 THEN 'judge_unavailable' WHEN src.k % 4 = 1 THEN 'judge_rejected' ELSE 'llm_disambiguation' END AS resolved_by, source, the_exact, first, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_exact, 0) AS n_exact FROM src LEFT JOIN per ON per.k = src.k)
SELECT k AS mention_id, source, resolved_by, CASE WHEN resolved_by = 'exact_label' THEN 'green' WHEN resolved_by IN ('judge_unavailable', 'llm_disambiguation') THEN 'yellow' WHEN resolved_by <> 'unknown' THEN 'red' END AS difficulty, CASE WHEN resolved_by = 'exact_label' THEN the_exact WHEN resolved_by = 'llm_disambiguation' THEN first END AS chosen, n_candidates, n_exact FROM f""")
def label_first_grounding(s, d):
    from lexigauge.functions.text import norm

    mentions, answers, entities, guesses = _ladder(s, d)
    found = ladder.candidates(mentions, answers, entities, guesses, ladder.Config(widen="label-guess"))
    k, ids = F.col("mention_id"), F.transform("candidates", lambda c: c["qid"])
    scope = (k % 3).cast("string")
    said = F.when(k % 4 == 2, F.get(ids, F.lit(0))).when(k % 4 == 3, "no candidate")
    term = norm(F.when(F.col("lemma") != "", F.col("lemma")).otherwise(F.col("surface")))
    decisions = found.where(F.size(ids) > 0).where(k % 4 != 0).select(scope.alias("scope"), F.coalesce(term, F.lit("")).alias("term"), F.sort_array(ids).alias("ids"), F.lit(True).alias("answered"), said.alias("qid"))
    return ladder.grounded(found, decisions, scope)


@query(f"""WITH {LADDER.replace("WHERE place < 5", "WHERE place < 7").replace("UNION ALL SELECT k, 1, 1, surface", "WHERE false UNION ALL SELECT k, 1, 1, surface")}, e AS (SELECT k, place, qid, exact AND qid LIKE 'E%' AND (k % 3 <> 0 OR k % 2 = 0) AS good FROM cand WHERE k IN (SELECT k FROM best WHERE rung = 1 AND NOT never)),
o AS (SELECT *, row_number() OVER (PARTITION BY k, qid ORDER BY good DESC, place) AS again FROM e), l AS (SELECT k, list(qid ORDER BY NOT good, place)[:4] AS pool FROM o WHERE again = 1 GROUP BY 1), n AS (SELECT k, count(*) FILTER (good) AS n, min(qid) FILTER (good) AS one FROM e GROUP BY 1)
SELECT m.k AS mention_id, CASE WHEN n.k IS NULL THEN 'no_candidates' WHEN n = 1 THEN 'exact_label' ELSE 'ambiguous_candidates' END AS resolved_by, CASE WHEN n = 1 THEN one END AS chosen, coalesce(array_to_string(pool, ','), '') AS pool FROM m LEFT JOIN n ON n.k = m.k LEFT JOIN l ON l.k = m.k""")
def plausible_pool(s, d):
    mentions, answers, entities, _ = _ladder(s, d)
    domain = mentions.select("mention_id", F.when(F.col("mention_id") % 3 == 0, "place").alias("domain"))
    out = ladder.enriched(mentions, answers, entities, domain)
    return out.withColumn("pool", F.array_join("pool", ","))

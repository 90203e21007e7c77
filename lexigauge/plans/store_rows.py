"""Queries of rows of the score store: shown, merged, billed."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigauge.operators import scores, store
from lexigauge.plans.catalog import CRIT, SCORE
from lexigauge.plans.registry import query
from lexigauge.sources import tables
from lexigauge.sources.tables import table


@query("""SELECT p_partkey::VARCHAR AS id, p_size AS paragraph_id, CASE WHEN p_size % 4 < 3 THEN ['green', 'yellow', 'red'][1 + p_size % 4] END AS difficulty, NULL AS pair_accuracy, CASE WHEN p_partkey % 3 = 0 THEN 'Q' || p_partkey END AS qid, CASE WHEN p_partkey % 3 = 2 THEN 2 ELSE 0 END::BIGINT AS n_candidates, CASE WHEN p_partkey % 3 = 2 THEN p_brand END AS second, CASE WHEN p_partkey % 5 = 0 THEN 'x' END AS trace FROM part""")
def stored_terms(s, d):
    k = F.col("p_partkey")
    colour = F.element_at(F.array(F.lit("green"), F.lit("yellow"), F.lit("red"), F.lit("blue")), (F.col("p_size") % 4 + 1).cast("int"))
    grounded = F.when(k % 3 == 0, F.to_json(F.struct(F.concat(F.lit("Q"), k).alias("qid"), F.col("p_name").alias("label")))).when(k % 3 == 1, "")
    cands = F.when(k % 3 == 2, F.to_json(F.array(F.struct(F.col("p_name").alias("label")), F.struct(F.col("p_brand").alias("label")))))
    rows = table(s, d, "part").select(k.alias("id"), F.col("p_size").alias("paragraph_id"), F.col("p_name").alias("source_surface"), colour.alias("difficulty"), F.lit("Green").alias("pair_accuracy"), grounded.alias("grounded_json"), cands.alias("candidates_json"), F.when(k % 5 == 0, F.lit('{"a": "x"}')).alias("trace_json"))
    out = store.terms(rows)
    return out.select("id", "paragraph_id", "difficulty", "pair_accuracy", F.col("grounded.qid").alias("qid"), F.size("candidates").cast("long").alias("n_candidates"), F.get("candidates", F.lit(1))["label"].alias("second"), F.col("trace").getItem("a").alias("trace"))


@query(f"""WITH {CRIT}, {SCORE}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY para, crit ORDER BY ts DESC, id DESC) AS r FROM score WHERE kind IN ('seed', 'live')) WHERE r = 1), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY para, crit ORDER BY ts DESC, id DESC) AS r FROM score WHERE kind = 'cache') WHERE r = 1),
b AS (SELECT coalesce(f.para, l.para) AS para, coalesce(f.crit, l.crit) AS crit, coalesce(f.value, l.value) AS value FROM l FULL JOIN f ON l.para = f.para AND l.crit = f.crit)
SELECT para, round(CAST(sum(CAST((value - lo) / (hi - lo) AS DECIMAL(18, 10)) * weight) AS DOUBLE) / sum(weight) * 10, 2) AS aggregate, (SELECT string_agg(crit, '+' ORDER BY crit) FROM crit WHERE enabled) AS criteria_key FROM b JOIN crit USING (crit) WHERE enabled AND para IN (SELECT para FROM f) GROUP BY para""")
def evaluation_merge(s, d):
    sc = tables.scores(s, d)
    return store.evaluated(scores.newest(scores.live(sc), ["para", "crit"]), scores.newest(sc.where("kind = 'cache'"), ["para", "crit"]), tables.criteria(s))


STATUS = "CASE k % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'dismissed' ELSE 'open' END"


@query(f"WITH {SCORE}, o AS (SELECT para, id % 97 AS id, {STATUS} AS status, id AS place FROM score WHERE k % 3 = 0), w AS (SELECT para, id % 97 AS id, 'open' AS status, id AS place FROM score WHERE k % 2 = 0), u AS (SELECT *, 'own' AS side FROM o WHERE status <> 'open' UNION ALL SELECT *, 'sent' FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY para, id ORDER BY side, place) AS r FROM u) SELECT para, id, status, side FROM r WHERE r = 1")
def issues_after_evaluation(s, d):
    sc = tables.scores(s, d)
    status = F.expr(STATUS)
    own = sc.where("k % 3 = 0").select("para", (F.col("id") % 97).alias("id"), status.alias("status"), F.col("id").alias("place"))
    sent = sc.where("k % 2 = 0").select("para", (F.col("id") % 97).alias("id"), F.lit("open").alias("status"), F.col("id").alias("place"))
    return store.merged_issues(own, sent)


@query(f"WITH {SCORE} SELECT para, id % 5 AS place, id FROM score WHERE k % 3 = 0 AND {STATUS} = 'open' AND crit IN ('view', 'click') AND k % 2 = 0")
def shown_issues(s, d):
    sc = tables.scores(s, d)
    issues = sc.where("k % 3 = 0").select("para", "id", "crit", F.expr(STATUS).alias("status"))
    asked = sc.where("k % 2 = 0").select("para", (F.col("id") % 5).alias("place"), "id")
    return store.shown_issues(asked, issues, s.sql("SELECT * FROM VALUES ('view'), ('click') t(crit)"))


@query(f"WITH {SCORE} SELECT para, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM score WHERE k % 3 = 0 AND {STATUS} = 'open' AND k % 5 > 1 GROUP BY para")
def issues_to_accept(s, d):
    suggestion = F.when(F.col("k") % 5 == 0, "").when(F.col("k") % 5 > 1, "x")
    out = store.to_accept(tables.scores(s, d).where("k % 3 = 0").select("para", "id", F.expr(STATUS).alias("status"), suggestion.alias("suggestion")))
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""WITH g AS (SELECT p_name AS term, min('old') AS en FROM part WHERE p_size % 2 = 0 GROUP BY 1), e AS (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY place DESC) AS r FROM (SELECT upper(p_name) AS term, 'new' || p_partkey AS en, p_partkey AS place FROM part WHERE p_size % 3 = 0)),
n AS (SELECT term, en FROM e WHERE r = 1), u AS (SELECT * FROM g WHERE lower(term) NOT IN (SELECT lower(term) FROM n) UNION ALL SELECT * FROM n) SELECT term, en FROM u""")
def glossary_upsert(s, d):
    p = table(s, d, "part")
    old = p.where("p_size % 2 = 0").select(F.col("p_name").alias("term"), F.lit("old").alias("en")).distinct()
    return store.glossary_with(old, p.where("p_size % 3 = 0").select(F.upper("p_name").alias("term"), F.concat(F.lit("new"), "p_partkey").alias("en"), F.col("p_partkey").alias("place")))


@query("WITH g AS (SELECT p_name AS term, max(p_brand) AS en FROM part WHERE p_size % 2 = 0 GROUP BY 1) SELECT p_partkey, en FROM part LEFT JOIN g ON lower(p_name) = lower(term)")
def glossary_lookup(s, d):
    p = table(s, d, "part")
    g = p.where("p_size % 2 = 0").groupBy(F.col("p_name").alias("term")).agg(F.max("p_brand").alias("en"))
    return store.glossary_hits(p.select("p_partkey", F.upper("p_name").alias("term")), g).select("p_partkey", "en")


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 50 AS m, o_orderkey % 900 AS prompt, o_orderkey % 300 AS most, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 70 ELSE 0 END AS more FROM orders)
SELECT o_orderkey, round(CASE WHEN m % 5 = 4 THEN prompt * 1e-5 + (most + more) * 3e-5 ELSE prompt * m * 1e-6 + (most + more) * m * 2e-6 END, 8) AS estimate FROM r""")
def call_estimates(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders")
    calls = o.select("o_orderkey", (F.col("o_custkey") % 50).alias("model"), (k % 900).alias("prompt_tokens"), (k % 300).alias("max_tokens"), F.when(k % 3 == 0, "max_tokens").otherwise("effort").alias("reasoning"), (k % 70).alias("reasoning_tokens"))
    prices = calls.select("model").distinct().where("model % 5 <> 4").select("model", (F.col("model") * 1e-6).alias("price_in"), (F.col("model") * 2e-6).alias("price_out"))
    return store.costs(calls, prices).select("o_orderkey", F.round("estimate", 8).alias("estimate"))


@query("""SELECT c_custkey AS doc_id, c_custkey IN (SELECT o_custkey FROM orders) AS scored, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS termed, CASE WHEN c_custkey % 7 = 0 THEN 'done' ELSE 'none' END AS terms_status FROM customer""")
def document_flags(s, d):
    o = table(s, d, "orders")
    docs = table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 7 == 0, "seed").otherwise("user").alias("origin"))
    out = store.existing(docs, ("scored", o, "o_custkey"), ("termed", o.where("o_totalprice > 200000"), "o_custkey"))
    return out.select("doc_id", "scored", "termed", store.settled_status(F.lit("none"), F.col("origin")).alias("terms_status"))

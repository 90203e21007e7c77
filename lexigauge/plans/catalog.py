"""Queries over the driver's tables, one per operator of the library, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigauge.functions import forms
from lexigauge.functions import text as T
from lexigauge.operators import anchors, decisions, evaluation, extraction, lookups, matching, pairing, rules, scores, shaping, spans, stats
from lexigauge.plans.registry import QUERIES, SQL, query  # noqa: F401
from lexigauge.sources import tables
from lexigauge.sources.tables import CRITERIA, table

CRIT = "crit(crit, lo, hi, weight, enabled) AS (VALUES " + ", ".join(f"('{c}', {lo}::DOUBLE, {hi}::DOUBLE, {w}, {on})" for c, lo, hi, w, on in CRITERIA) + ")"
SCORE = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
score AS (SELECT user_id AS para, event_type AS crit, value, ts, event_id AS id, k, CASE WHEN k % 10 < 2 THEN 'seed' WHEN k % 10 = 2 THEN 'cache' WHEN k % 10 = 3 THEN 'archived' ELSE 'live' END AS kind FROM e)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY para, crit ORDER BY ts DESC, id DESC) AS r FROM score WHERE kind IN ('seed', 'live'))"
LINES = "lines AS (SELECT doc_id, u.i - 1 AS idx, u.line FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) u WHERE trim(u.line) <> '')"
WORDS = """w AS MATERIALIZED (SELECT doc_id AS title, i - 1 AS idx, surface, lower(regexp_replace(surface, '[^A-Za-z]', '', 'g')) AS qid FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS surface, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)),
gold AS (SELECT *, 1 + idx % 2 AS span FROM w WHERE length(qid) > 5 AND regexp_matches(surface, '^[A-Z]')),
pred AS (SELECT title, idx - CASE WHEN length(qid) % 5 = 0 THEN 1 ELSE 0 END AS idx, surface, qid, 1 + length(qid) % 3 AS span, idx AS id, [CASE WHEN length(qid) % 7 <> 0 THEN qid ELSE 'none' END, substr(qid, 1, 4)] AS cands FROM w WHERE length(qid) > 5 AND (length(qid) % 2 = 1 OR length(qid) > 9))"""
LAST = "last AS (SELECT title, idx, span, arg_max(qid, id) AS qid, arg_max(cands, id) AS cands FROM pred GROUP BY ALL)"
ISSUES = "iss AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'accepted' WHEN k % 7 = 1 THEN 'dismissed' WHEN k % 7 = 2 THEN 'outdated' ELSE 'open' END AS status FROM score WHERE k % 3 = 0)"


def _latest(s, d):
    return scores.newest(scores.live(tables.scores(s, d)), ["para", "crit"])


@query(f"WITH {SCORE}, {RANKED} SELECT para, crit, value, id, kind FROM ranked WHERE r = 1")
def latest_score(s, d):
    return _latest(s, d).select("para", "crit", "value", "id", "kind")


@query(f"WITH {SCORE}, {RANKED} SELECT para, crit, value, id, kind FROM ranked WHERE r = 2")
def prev_score(s, d):
    return scores.newest(scores.live(tables.scores(s, d)), ["para", "crit"], 2).select("para", "crit", "value", "id", "kind")


@query(f"WITH {SCORE}, b AS (SELECT *, row_number() OVER (PARTITION BY para, crit ORDER BY ts DESC, id DESC) AS r FROM score WHERE kind = 'seed') SELECT para, crit, value FROM b WHERE r = 1")
def baseline_score(s, d):
    return scores.newest(tables.scores(s, d).where("kind = 'seed'"), ["para", "crit"]).select("para", "crit", "value")


AGG = f"{CRIT}, {SCORE}, {RANKED}, agg AS (SELECT para, round(CAST(sum(CAST((value - lo) / (hi - lo) AS DECIMAL(18, 10)) * weight) AS DOUBLE) / sum(weight) * 10, 2) AS aggregate FROM ranked JOIN crit USING (crit) WHERE r = 1 AND enabled GROUP BY para)"


@query(f"WITH {AGG} SELECT para, aggregate, (SELECT string_agg(crit, '+' ORDER BY crit) FROM crit WHERE enabled) AS criteria_key FROM agg")
def paragraph_aggregate(s, d):
    return scores.weighted(_latest(s, d), tables.criteria(s), ["para"])


@query(f"WITH {AGG} SELECT para % 20 AS doc, round(CAST(sum(CAST(aggregate AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 2) AS mean_aggregate, count(*) AS n FROM agg GROUP BY 1")
def doc_mean_aggregate(s, d):
    a = scores.weighted(_latest(s, d), tables.criteria(s), ["para"])
    exact = F.sum(F.col("aggregate").cast("decimal(18,2)")).cast("double") / F.count("*")
    return a.groupBy((F.col("para") % 20).alias("doc")).agg(F.round(exact, 2).alias("mean_aggregate"), F.count("*").alias("n"))


@query(f"WITH {CRIT}, {SCORE}, {RANKED} SELECT para, round(coalesce(CAST(sum(CAST(value AS DECIMAL(18, 2)) * weight) AS DOUBLE) / sum(weight), 0), 6) AS consensus FROM ranked JOIN crit USING (crit) WHERE r = 1 GROUP BY para")
def consensus(s, d):
    v = _latest(s, d).withColumn("value", F.col("value").cast("decimal(18,2)"))
    c = tables.criteria(s).withColumn("weight", F.col("weight").cast("decimal(4,0)"))
    return scores.consensus(v, c, ["para"]).select("para", F.round(F.col("consensus").cast("double"), 6).alias("consensus"))


@query(f"""WITH {CRIT}, {SCORE}, on_ AS (SELECT * FROM crit WHERE enabled), rows_ AS (SELECT * FROM score WHERE crit IN (SELECT crit FROM on_)),
v AS (SELECT para, ts, crit, arg_max(value, id) AS value FROM rows_ GROUP BY ALL),
g AS (SELECT p.para, p.ts, o.crit, lo, hi, weight, value FROM (SELECT DISTINCT para, ts FROM rows_) p CROSS JOIN on_ o LEFT JOIN v ON v.para = p.para AND v.ts = p.ts AND v.crit = o.crit),
h AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY para, crit ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM g)
SELECT para, ts, round(CAST(sum(CAST((held - lo) / (hi - lo) AS DECIMAL(18, 10)) * weight) AS DOUBLE) / sum(weight) * 10, 9) AS aggregate, count(*) AS n_crit FROM h WHERE held IS NOT NULL GROUP BY para, ts""")
def carry_forward_aggregate(s, d):
    return scores.carry_forward(tables.scores(s, d), tables.criteria(s), 9)


REV = "rev AS (SELECT para, CASE WHEN k % 11 <> 0 THEN k % 9 END AS revision, CAST(round(CAST(value AS DECIMAL(18, 4)) * 0.02, 2) AS DOUBLE) AS aggregate, kind, ts, id FROM score)"


def _revisions(s, d):
    return tables.scores(s, d).select("para", F.when(F.col("k") % 11 != 0, F.col("k") % 9).alias("revision"), F.round(F.col("value").cast("decimal(18,4)") * F.expr("0.02BD"), 2).cast("double").alias("aggregate"), "kind", "ts", "id")


@query(f"WITH {SCORE}, {REV}, b AS (SELECT *, row_number() OVER (PARTITION BY para ORDER BY aggregate DESC, ts DESC, id DESC) AS r FROM rev WHERE revision IS NOT NULL AND kind <> 'cache') SELECT b.para, b.revision, b.aggregate, b.revision = c.cur AS is_current FROM b JOIN (SELECT para, max(revision) AS cur FROM rev GROUP BY para) c USING (para) WHERE r = 1")
def best_revision(s, d):
    return scores.best_revision(_revisions(s, d))


@query(f"WITH {SCORE}, {REV} SELECT para, max(revision) AS revision FROM rev GROUP BY para")
def latest_revision(s, d):
    return _revisions(s, d).groupBy("para").agg(F.max("revision").alias("revision"))


def _issues(s, d):
    k = F.col("k") % 7
    return tables.scores(s, d).where("k % 3 = 0").withColumn("status", F.when(k == 0, "accepted").when(k == 1, "dismissed").when(k == 2, "outdated").otherwise("open"))


@query(f"WITH {SCORE}, {ISSUES} SELECT id, para, crit, status FROM iss i WHERE status IN ('accepted', 'dismissed') OR status = 'open' AND (kind = 'live' OR kind = 'seed' AND NOT EXISTS (SELECT 1 FROM score s WHERE s.kind = 'live' AND s.para = i.para AND s.crit = i.crit))")
def visible_issues(s, d):
    return scores.visible(_issues(s, d), tables.scores(s, d)).select("id", "para", "crit", "status")


@query(f"WITH {SCORE}, {ISSUES} SELECT id, para, crit FROM iss i WHERE status = 'open' AND NOT EXISTS (SELECT 1 FROM iss o WHERE o.status IN ('accepted', 'dismissed') AND o.para = i.para AND o.crit = i.crit AND o.k = i.k)")
def issue_dedupe_antijoin(s, d):
    i = _issues(s, d)
    closed = i.where(F.col("status").isin("accepted", "dismissed")).select("para", "crit", "k").distinct()
    return i.where("status = 'open'").join(closed, ["para", "crit", "k"], "left_anti").select("id", "para", "crit")


@query(f"WITH {SCORE} SELECT id, para, value, kind, CASE WHEN kind = 'live' THEN 'archived' WHEN kind = 'seed' THEN 'open' ELSE kind END AS after_reset FROM score")
def reset_document(s, d):
    return tables.scores(s, d).select("id", "para", "value", "kind", F.when(F.col("kind") == "live", "archived").when(F.col("kind") == "seed", "open").otherwise(F.col("kind")).alias("after_reset"))


@query(f"WITH {SCORE}, h AS (SELECT id, para, kind, lag(kind) OVER (PARTITION BY para ORDER BY id) AS b FROM score) SELECT id, para, kind FROM h WHERE b IS DISTINCT FROM kind")
def revision_changes(s, d):
    return scores.changed(tables.scores(s, d).select("id", "para", "kind"), "para", "id", "kind")


@query(f"WITH {SCORE}, {RANKED}, p AS (SELECT para, crit, value FROM ranked WHERE r = 2), b AS (SELECT para, crit, arg_max(value, id) AS value FROM score WHERE kind = 'seed' GROUP BY ALL) SELECT l.para, l.crit, round(l.value - coalesce(p.value, b.value), 2) AS delta FROM ranked l LEFT JOIN p USING (para, crit) LEFT JOIN b USING (para, crit) WHERE l.r = 1")
def chip_delta(s, d):
    allv = tables.scores(s, d)
    prev = scores.newest(scores.live(allv), ["para", "crit"], 2).select("para", "crit", F.col("value").alias("p"))
    base = allv.where("kind = 'seed'").groupBy("para", "crit").agg(F.max_by("value", "id").alias("b"))
    return _latest(s, d).join(prev, ["para", "crit"], "left").join(base, ["para", "crit"], "left").select("para", "crit", F.round(F.col("value") - F.coalesce("p", "b"), 2).alias("delta"))


@query(f"WITH {SCORE}, n AS (SELECT id, para, kind FROM score WHERE k % 2 = 0), o AS (SELECT id, para, 'old' AS kind FROM score WHERE k % 3 = 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def upsert_scores(s, d):
    v = tables.scores(s, d)
    return scores.upsert(v.where("k % 3 = 0").select("id", "para", F.lit("old").alias("kind")), v.where("k % 2 = 0").select("id", "para", "kind"), ["id"])


@query("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) UNION ALL SELECT -s_suppkey - 1 FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)")
def unreferenced_keys(s, d):
    a = table(s, d, "customer").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")
    b = table(s, d, "supplier").join(table(s, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_anti")
    return a.unionAll(b.select((-F.col("s_suppkey") - 1).alias("c_custkey")))


def _mentions(s, d):
    return tables.mentions(s, d, "gold"), tables.mentions(s, d, "pred")


NORM = "replace(lower(trim(regexp_replace(translate(regexp_replace(nfc_normalize({}), '[‐-―−]', '-', 'g'), 'ёЁ', 'еЕ'), '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query(f"SELECT p_partkey, {NORM.format("'Ёлка –  ' || chr(101) || chr(769) || '  ' || p_name || '−STRAßE '")} AS key FROM part")
def norm_key(s, d):
    raw = F.concat(F.lit("Ёлка –  e\u0301  "), "p_name", F.lit("−STRAßE "))
    return table(s, d, "part").select("p_partkey", T.norm(raw).alias("key"))


BOTH = "SELECT 'gold' AS side, title, idx, surface, qid, span FROM gold {0} UNION ALL SELECT 'pred', title, idx, surface, qid, span FROM pred {1}"


@query(f"WITH {WORDS}, gn AS (SELECT DISTINCT title, idx, qid, {NORM.format('surface')} AS n FROM gold), pn AS (SELECT DISTINCT title, idx, qid, {NORM.format('surface')} AS n FROM pred) " + BOTH.format(f"WHERE (title, idx, qid, {NORM.format('surface')}) IN (SELECT (title, idx, qid, n) FROM pn)", f"WHERE (title, idx, qid, {NORM.format('surface')}) IN (SELECT (title, idx, qid, n) FROM gn)"))
def match_strict(s, d):
    return matching.strict(*_mentions(s, d))


@query(f"WITH {WORDS}, same AS MATERIALIZED (SELECT title, qid, g.idx AS gi, g.span AS gs, p.idx AS pi, p.span AS ps FROM gold g JOIN pred p USING (title, qid)) SELECT title, gi AS gold_idx, pi AS pred_idx, qid FROM same WHERE gi < pi + greatest(ps, 1) AND pi < gi + greatest(gs, 1)")
def match_overlap(s, d):
    return matching.overlapping(*_mentions(s, d)).select(F.col("g.title"), F.col("g.idx").alias("gold_idx"), F.col("p.idx").alias("pred_idx"), F.col("g.qid"))


@query(f"WITH {WORDS} " + BOTH.format("SEMI JOIN (SELECT DISTINCT title, qid FROM pred) USING (title, qid)", "SEMI JOIN (SELECT DISTINCT title, qid FROM gold) USING (title, qid)"))
def match_document(s, d):
    return matching.document(*_mentions(s, d))


@query(f"""WITH {WORDS}, gk AS (SELECT title, qid, bool_or(regexp_matches(surface, '^\\p{{Lu}}')) AS up, bool_and(regexp_matches(surface, '^\\p{{Lu}}')) AS al FROM gold WHERE surface <> '' GROUP BY ALL),
pk AS (SELECT title, qid, bool_or(regexp_matches(surface, '^\\p{{Lu}}')) AS up, bool_and(regexp_matches(surface, '^\\p{{Lu}}')) AS al FROM pred WHERE surface <> '' GROUP BY ALL)
SELECT CASE WHEN coalesce(g.al, p.al) THEN 'named' WHEN coalesce(g.up, p.up) THEN 'ambiguous' ELSE 'term' END AS class, count(*) FILTER (g.qid IS NOT NULL AND p.qid IS NOT NULL) AS tp, count(*) FILTER (p.qid IS NULL) AS fn, count(*) FILTER (g.qid IS NULL) AS fp
FROM gk g FULL JOIN pk p ON g.title = p.title AND g.qid = p.qid GROUP BY 1""")
def confusion_micro(s, d):
    return matching.by_class(*_mentions(s, d))


@query(f"""WITH {WORDS}, {LAST}, hit AS (SELECT g.title, g.qid, true AS rec, bool_or(list_contains(p.cands, g.qid)) AS found, bool_or(p.qid = g.qid AND list_contains(p.cands, g.qid)) AS ok
FROM gold g JOIN last p ON p.title = g.title AND g.idx < p.idx + greatest(p.span, 0) AND p.idx < g.idx + greatest(g.span, 0) GROUP BY g.title, g.qid), dir AS (SELECT DISTINCT title, qid FROM last)
SELECT count(*) AS n_gold, count(*) FILTER (h.rec) AS n_rec, count(*) FILTER (h.found) AS n_found, count(*) FILTER (h.ok) AS n_ok, count(*) FILTER (dir.qid IS NOT NULL) AS n_direct
FROM (SELECT DISTINCT title, qid FROM gold) g LEFT JOIN hit h USING (title, qid) LEFT JOIN dir USING (title, qid)""")
def survival_funnel(s, d):
    return matching.survival(*_mentions(s, d))


@query("""WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source),
w AS (SELECT source, k, n, k / n AS p, 3.8416 AS zz FROM c)
SELECT source, k, n, round(greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 4) AS low, round(least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 4) AS high, n < 30 AS underpowered FROM w""")
def wilson_cells(s, d):
    c = table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("source", "k", "n", low.alias("low"), high.alias("high"), (F.col("n") < 30).alias("underpowered"))


VERDICTS = "v AS (SELECT CASE WHEN k % 3 = 0 THEN 'green' WHEN k % 3 = 1 THEN 'yellow' ELSE 'red' END AS truth, CASE WHEN k % 5 < 2 THEN 'green' WHEN k % 5 = 2 THEN 'yellow' WHEN k % 5 = 3 THEN 'red' ELSE 'odd' END AS guess, crit FROM score)"
LABELS = ["green", "yellow", "red"]


def _verdicts(s, d):
    k = F.col("k")
    return tables.scores(s, d).select(F.when(k % 3 == 0, "green").when(k % 3 == 1, "yellow").otherwise("red").alias("truth"), F.when(k % 5 < 2, "green").when(k % 5 == 2, "yellow").when(k % 5 == 3, "red").otherwise("odd").alias("guess"), "crit")


@query(f"WITH {SCORE}, {VERDICTS}, l AS (SELECT unnest(['green', 'yellow', 'red']) AS label), c AS (SELECT label, count(*) FILTER (truth = label AND guess = label) AS tp, count(*) FILTER (truth = label) AS t, count(*) FILTER (guess = label) AS p FROM v, l GROUP BY label) SELECT round(avg(2 * tp / (t + p)), 4) AS macro_f1, count(*) AS n_labels FROM c WHERE t > 0")
def macro_f1(s, d):
    return stats.macro_f1(_verdicts(s, d), "truth", "guess", LABELS)


@query(f"WITH {SCORE}, {VERDICTS}, l AS (SELECT unnest(['green', 'yellow', 'red']) AS label) SELECT a.label AS truth, b.label AS guess, (SELECT count(*) FROM v WHERE v.truth = a.label AND v.guess = b.label) AS n FROM l a, l b")
def confusion_dense(s, d):
    return stats.confusion(_verdicts(s, d), "truth", "guess", LABELS)


SHARES = {"p50": 0.5, "p95": 0.95}


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (r = least(n, CAST(floor(0.5 * n) AS BIGINT) + 1)) AS p50, max(value) FILTER (r = least(n, CAST(floor(0.95 * n) AS BIGINT) + 1)) AS p95, max(n) AS n FROM r GROUP BY event_type")
def latency_nearest_rank(s, d):
    return stats.by_rank(table(s, d, "events"), "event_type", "value", SHARES, "floor")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type")
def percentile_ceil(s, d):
    return stats.by_rank(table(s, d, "events"), "event_type", "value", SHARES, "ceil")


@query(f"WITH {SCORE}, {VERDICTS}, a AS (SELECT crit, round(avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END), 4) AS acc, count(*) AS n FROM v GROUP BY crit) SELECT crit, acc, n, row_number() OVER (ORDER BY acc DESC, n, crit) AS place FROM a")
def select_winner(s, d):
    from pyspark.sql import Window

    a = _verdicts(s, d).groupBy("crit").agg(F.round(F.avg((F.col("truth") == F.col("guess")).cast("double")), 4).alias("acc"), F.count("*").alias("n"))
    return a.withColumn("place", F.row_number().over(Window.orderBy(F.desc("acc"), "n", "crit")).cast("long"))


@query(f"WITH {WORDS}, g AS (SELECT DISTINCT title, qid FROM gold), p AS (SELECT DISTINCT title, qid FROM pred) SELECT coalesce(g.title, p.title) AS title, count(*) FILTER (g.qid IS NOT NULL AND p.qid IS NOT NULL) AS n_both, count(*) FILTER (p.qid IS NULL) AS n_missed, count(*) FILTER (g.qid IS NULL) AS n_spurious FROM g FULL JOIN p ON g.title = p.title AND g.qid = p.qid GROUP BY 1")
def extraction_prf(s, d):
    g, p = (m.select("title", "qid").distinct().withColumn(c, F.lit(True)) for m, c in zip(_mentions(s, d), "gp"))
    return g.join(p, ["title", "qid"], "full_outer").groupBy("title").agg(F.count_if(F.col("g") & F.col("p")).alias("n_both"), F.count_if(F.col("p").isNull()).alias("n_missed"), F.count_if(F.col("g").isNull()).alias("n_spurious"))


@query("""WITH r AS (SELECT l_returnflag AS k, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem)
SELECT k AS l_returnflag, count(*) AS n, round(corr(a, b), 4) AS rho FROM r GROUP BY k""")
def spearman_avg_rank(s, d):
    return stats.spearman(table(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_discount")


@query("""WITH p AS (SELECT a.l_orderkey AS k, sign(a.l_quantity - b.l_quantity) AS s, sign(a.l_tax - b.l_tax) AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT k AS l_orderkey, CASE WHEN sum(abs(s)) > 0 AND sum(abs(t)) > 0 THEN round(sum(s * t) / sqrt(sum(abs(s)) * sum(abs(t))), 4) END AS tau FROM p GROUP BY k""")
def kendall_tau_b(s, d):
    return stats.kendall(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", "l_tax")


@query("WITH n AS (SELECT l_returnflag, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(*) AS n_distinct, arg_max(v, (n, -v)) AS modal, round(max(n) / sum(n), 4) AS modal_share FROM n GROUP BY 1")
def tie_stats(s, d):
    return stats.ties(table(s, d, "lineitem"), "l_returnflag", "l_quantity")


DELTA = "dl AS (SELECT a.l_orderkey, round(b.l_quantity - a.l_quantity, 2) AS dq, round(b.l_discount - a.l_discount, 2) AS dd FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)"


def _deltas(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    a, b = li.where("l_linenumber = 1").alias("a"), li.where("l_linenumber = 2").alias("b")
    return a.join(b, "l_orderkey").select("l_orderkey", F.round(F.col("b.l_quantity") - F.col("a.l_quantity"), 2).alias("dq"), F.round(F.col("b.l_discount") - F.col("a.l_discount"), 2).alias("dd"))


@query(f"WITH {DELTA} SELECT round(avg(CASE WHEN sign(dq) = sign(dd) THEN 1.0 ELSE 0.0 END), 4) AS agreement, count(*) AS n FROM dl WHERE dq <> 0 AND dd <> 0")
def sign_agreement(s, d):
    x = _deltas(s, d).where("dq <> 0 and dd <> 0")
    return x.agg(F.round(F.avg((F.signum("dq") == F.signum("dd")).cast("double")), 4).alias("agreement"), F.count("*").alias("n"))


@query(f"WITH {DELTA}, u AS (SELECT 'quantity' AS metric, CAST(dq AS DECIMAL(18, 2)) AS v FROM dl UNION ALL SELECT 'discount', CAST(dd AS DECIMAL(18, 2)) FROM dl) SELECT metric, round(CAST(sum(v) AS DOUBLE) / count(*), 4) AS mean_delta, count(*) AS n FROM u GROUP BY metric")
def paired_deltas(s, d):
    u = _deltas(s, d).select(F.explode(F.array(F.struct(F.lit("quantity").alias("metric"), F.col("dq").alias("v")), F.struct(F.lit("discount").alias("metric"), F.col("dd").alias("v")))).alias("x")).select("x.metric", F.col("x.v").cast("decimal(18,2)").alias("v"))
    return u.groupBy("metric").agg(F.round(F.sum("v").cast("double") / F.count("*"), 4).alias("mean_delta"), F.count("*").alias("n"))


REDIRECTS = "red AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 17 = 3 THEN p_partkey + 1 WHEN p_partkey % 17 = 4 THEN p_partkey - 1 ELSE p_partkey // 2 END AS dst FROM part WHERE p_partkey > 0)"


@query(f"""WITH RECURSIVE {REDIRECTS}, walk AS (SELECT p_partkey AS title, p_partkey AS here, [p_partkey] AS seen FROM part
UNION ALL SELECT title, dst, list_append(seen, dst) FROM walk JOIN red ON red.src = walk.here WHERE NOT list_contains(seen, dst) AND len(seen) <= 10)
SELECT title, arg_max(here, len(seen)) AS target, max(len(seen)) - 1 AS n_hops FROM walk GROUP BY title""")
def redirect_chain(s, d):
    p = F.col("p_partkey")
    part = table(s, d, "part").select("p_partkey")
    red = part.where("p_partkey > 0").select(p.alias("src"), F.when(p % 17 == 3, p + 1).when(p % 17 == 4, p - 1).otherwise(F.floor(p / 2)).alias("dst"))
    return shaping.redirect_chain(part.select(p.alias("title")), red)


@query("""WITH s AS (SELECT p_brand AS key, 'a' AS source, 1 AS prio, CASE WHEN p_size % 2 = 0 THEN p_name END AS name, NULL AS kind FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_brand, 'b', 2, p_name, p_type FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_brand, 'c', 3, NULL, p_type FROM part WHERE p_partkey % 3 = 2)
SELECT key, arg_min(name, (prio, name)) FILTER (name IS NOT NULL) AS name, arg_min(kind, (prio, kind)) FILTER (kind IS NOT NULL) AS kind, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM s GROUP BY key""")
def golden_merge(s, d):
    p, none = table(s, d, "part"), F.lit(None).cast("string")
    row = lambda k, name, prio, n, t: p.where(f"p_partkey % 3 = {k}").select(F.col("p_brand").alias("key"), F.lit(name).alias("source"), F.lit(prio).alias("prio"), n.alias("name"), t.alias("kind"))
    rows = row(0, "a", 1, F.when(F.col("p_size") % 2 == 0, F.col("p_name")), none).unionByName(row(1, "b", 2, F.col("p_name"), F.col("p_type"))).unionByName(row(2, "c", 3, none, F.col("p_type")))
    return shaping.merge_by_priority(rows, "key", ["name", "kind"])


@query("""WITH t AS (SELECT p_partkey AS pos, split_part(p_name, ' ', 2) || CAST(p_size % 9 AS VARCHAR) AS stem, CASE WHEN p_size % 4 > 0 THEN p_type END AS qid, CASE p_size % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS verdict, p_name AS translation FROM part),
o AS (SELECT stem, min(qid) AS only_ FROM t GROUP BY stem HAVING count(DISTINCT qid) = 1), n AS (SELECT t.*, coalesce(qid, only_, 'ungrounded') AS entity FROM t LEFT JOIN o USING (stem))
SELECT stem, entity, count(*) AS n, CASE WHEN bool_or(verdict = 'red') THEN 'red' WHEN bool_or(verdict = 'yellow') THEN 'yellow' ELSE 'green' END AS worst, arg_min(translation, pos) AS translation FROM n GROUP BY ALL""")
def glossary_groups(s, d):
    k = F.col("p_size") % 3
    t = table(s, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), (F.col("p_size") % 9).cast("string")).alias("stem"), F.when(F.col("p_size") % 4 > 0, F.col("p_type")).alias("qid"), F.when(k == 0, "green").when(k == 1, "yellow").otherwise("red").alias("verdict"), F.col("p_name").alias("translation"))
    return shaping.glossary_groups(t)


@query("WITH r AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS r, count(*) OVER () // 10 AS step FROM part) SELECT r // step AS bin, p_partkey, p_retailprice FROM r WHERE r < step * 10 AND r % step = (step - 1) // 2")
def decile_picks(s, d):
    return shaping.decile_picks(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice")


@query("""WITH sp AS (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + l_linenumber + 2 AS e FROM lineitem), ends AS (SELECT DISTINCT k, unnest([s, e]) AS a FROM sp), parts AS (SELECT k, a, lead(a) OVER (PARTITION BY k ORDER BY a) AS b FROM ends)
SELECT parts.k, a, b, count(*) AS n_cover FROM parts JOIN sp ON sp.k = parts.k AND s <= a AND b <= e GROUP BY ALL""")
def span_segments(s, d):
    q = F.col("l_quantity").cast("long")
    return shaping.segments(table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), q.alias("s"), (q + F.col("l_linenumber") + 2).alias("e")), "k")


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations")
def running_offsets(s, d):
    return shaping.offsets(table(s, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "start")


@query("SELECT conv_id, turn, right(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ''), 2000) AS context FROM conversations")
def rolling_context(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    return table(s, d, "conversations").select("conv_id", "turn", F.right(F.concat_ws("\n", F.collect_list("text").over(w)), F.lit(2000)).alias("context"))


@query("WITH c AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(round(o_totalprice) AS BIGINT) AS cost FROM orders), l AS (SELECT *, sum(cost) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM c) SELECT o_orderkey, CAST(spent AS BIGINT) AS spent, spent <= 1000000 AS fits FROM l")
def budget_ledger(s, d):
    c = table(s, d, "orders").withColumn("cost", F.round("o_totalprice").cast("long"))
    return shaping.ledger(c, "o_custkey", ["o_orderdate", "o_orderkey"], "cost", 1_000_000).select("o_orderkey", "spent", "fits")


@query("WITH a AS (SELECT event_type AS route, count(*) AS n, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) % 10 <> 0) AS good, round(median(value), 4) AS med FROM events GROUP BY 1) SELECT route, round(good / n, 4) AS success, med, CASE WHEN good / n >= 0.95 THEN 'good' WHEN good / n >= 0.5 THEN 'shaky' ELSE 'dead' END AS verdict FROM a")
def route_verdict(s, d):
    a = tables.scores(s, d).groupBy(F.col("crit").alias("route")).agg(F.count("*").alias("n"), F.count_if(F.col("k") % 10 != 0).alias("good"), F.round(F.median("value"), 4).alias("med"))
    share = F.col("good") / F.col("n")
    return a.select("route", F.round(share, 4).alias("success"), "med", F.when(share >= 0.95, "good").when(share >= 0.5, "shaky").otherwise("dead").alias("verdict"))


@query(f"WITH {LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS para, line FROM lines")
def paragraph_split(s, d):
    from pyspark.sql import Window

    return tables.lines(s, d).select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1).cast("long").alias("para"), "line")


@query("SELECT doc_id, len([t FOR t IN regexp_split_to_array(text, '\\s+') IF t <> '']) AS n_tokens, len(regexp_extract_all(substr(text, 1, 100), '\\s+')) AS at_100 FROM documents")
def token_index(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), T.token_index(F.col("text"), F.lit(100)).cast("long").alias("at_100"))


def _probe(s, d):
    return table(s, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 5 == 0, "Consider ").when(F.col("p_size") % 5 == 1, " use the ").otherwise(""), F.col("p_name"), F.when(F.col("p_size") % 7 == 0, " if needed").when(F.col("p_size") % 11 == 0, " 'one' or 'two'").when(F.col("p_size") % 13 == 0, " 'one', 'two'").otherwise("")).alias("s"))


ADVISES = "regexp_matches(s, '{}') OR regexp_matches(s, '{}')".format(T.ADVICE, T.QUOTED_CHOICE.replace("'", "''"))
PROBE = "pr AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Consider ' WHEN p_size % 5 = 1 THEN ' use the ' ELSE '' END || p_name || CASE WHEN p_size % 7 = 0 THEN ' if needed' WHEN p_size % 11 = 0 THEN ' ''one'' or ''two''' WHEN p_size % 13 = 0 THEN ' ''one'', ''two''' ELSE '' END AS s FROM part)"


@query(f"WITH {PROBE} SELECT p_partkey, ({ADVISES}) AS advice FROM pr")
def advice_flag(s, d):
    return _probe(s, d).select("p_partkey", T.is_advice(F.col("s")).alias("advice"))


@query(f"WITH {PROBE} SELECT p_partkey, CASE WHEN ({ADVISES}) THEN '' ELSE s END AS suggestion, CASE WHEN ({ADVISES}) THEN 'Advice: ' || trim(s) ELSE '' END AS explanation FROM pr")
def sanitize_issue(s, d):
    a = T.is_advice(F.col("s"))
    return _probe(s, d).select("p_partkey", F.when(a, "").otherwise(F.col("s")).alias("suggestion"), F.when(a, F.concat(F.lit("Advice: "), F.trim("s"))).otherwise("").alias("explanation"))


HREF = "CASE page_id % 6 WHEN 0 THEN './A+b%20' || page_id || '#part' WHEN 1 THEN '/wiki/Файл:x_' || page_id WHEN 2 THEN '/wiki/Portal_' || page_id WHEN 3 THEN '/x/' || page_id WHEN 4 THEN './Talk:' || page_id ELSE regexp_extract(html, '<a href=\"([^\"]*)\"', 1) END"


@query(f"""WITH h AS (SELECT page_id, {HREF} AS href FROM pages), b AS (SELECT page_id, href, translate(url_decode(regexp_replace(regexp_replace(href, '^(\\./|/wiki/)', ''), '#.*$', '')), '_', ' ') AS t FROM h)
SELECT page_id, CASE WHEN regexp_matches(href, '^(\\./|/wiki/)') AND NOT regexp_matches(t, '^({"|".join(T.NAMESPACES)})') THEN t END AS title FROM b""")
def href_title(s, d):
    k, p = F.col("page_id") % 6, F.col("page_id").cast("string")
    href = F.when(k == 0, F.concat(F.lit("./A+b%20"), p, F.lit("#part"))).when(k == 1, F.concat(F.lit("/wiki/Файл:x_"), p)).when(k == 2, F.concat(F.lit("/wiki/Portal_"), p))
    href = href.when(k == 3, F.concat(F.lit("/x/"), p)).when(k == 4, F.concat(F.lit("./Talk:"), p)).otherwise(F.regexp_extract("html", r'<a href="([^"]*)"', 1))
    return table(s, d, "pages").select("page_id", T.link_title(href).alias("title"))


@query(f"WITH {SCORE} SELECT id, CASE WHEN value / 40 >= 8 THEN 'green' WHEN value / 40 >= 6 THEN 'yellow' ELSE 'red' END AS colour FROM score")
def score_color(s, d):
    return tables.scores(s, d).select("id", T.colour(F.col("value") / 40).alias("colour"))


@query(f"WITH {LINES} SELECT doc_id, count(*) FILTER (NOT (upper(line) = line AND regexp_matches(line, '\\p{{L}}'))) AS n_body FROM lines GROUP BY doc_id")
def body_lines(s, d):
    return tables.lines(s, d).groupBy("doc_id").agg(F.count_if(T.is_body(F.col("line"))).alias("n_body"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, sha256(p_name || '|' || p_type) AS key FROM part")
def slug_and_key(s, d):
    return table(s, d, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), F.sha2(F.concat_ws("|", "p_name", "p_type"), 256).alias("key"))


@query("SELECT p_partkey, CAST(regexp_extract(CASE WHEN p_size % 2 = 0 THEN '-' ELSE '+' END || CAST(p_size * 40 AS VARCHAR) || '-01-01T00:00:00Z', '^([+-]?\\d{1,6})-', 1) AS INT) AS year FROM part")
def parse_year(s, d):
    return table(s, d, "part").select("p_partkey", T.signed_year(F.concat(F.when(F.col("p_size") % 2 == 0, "-").otherwise("+"), (F.col("p_size") * 40).cast("string"), F.lit("-01-01T00:00:00Z"))).alias("year"))


@query("SELECT conv_id, turn, len(list_intersect(a, b)) >= 0.6 * len(a) AS covered FROM (SELECT x.conv_id, x.turn, list_distinct([substr(t, 1, 4) FOR t IN regexp_split_to_array(lower(x.text), '\\s+') IF t <> '']) AS a, list_distinct([substr(t, 1, 4) FOR t IN regexp_split_to_array(lower(y.text), '\\s+') IF t <> '']) AS b FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)")
def stem_coverage(s, d):
    c = table(s, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", T.shares_stems(T.stems(F.col("text")), T.stems(F.col("other"))).alias("covered"))


@query(f"WITH {LINES}, r AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS r FROM lines) SELECT doc_id, idx FROM r WHERE r <= 12")
def first_paragraphs(s, d):
    from pyspark.sql import Window

    return tables.lines(s, d).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))).where("r <= 12").select("doc_id", F.col("idx").cast("long").alias("idx"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n, round(avg(length(line)), 4) AS mean_len, median(length(line)) AS median_len, max(length(line)) AS max_len FROM lines GROUP BY doc_id")
def char_stats(s, d):
    n = F.length("line")
    return tables.lines(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean_len"), F.median(n).alias("median_len"), F.max(n).cast("long").alias("max_len"))


@query("WITH n AS (SELECT p_partkey AS id, lower(trim(p_name)) AS norm, 1 AS rank FROM part UNION ALL SELECT p_partkey, lower(p_brand || ' ' || p_name), 2 FROM part), q AS (SELECT DISTINCT lower(CASE WHEN p_size < 10 THEN p_name ELSE p_brand || ' ' || p_name END) AS norm FROM part) SELECT q.norm, min(rank) AS rank, count(DISTINCT id) AS n_entities, min(id) AS first_id FROM q JOIN n USING (norm) GROUP BY q.norm")
def exact_label_match(s, d):
    p = table(s, d, "part")
    names = p.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.struct(F.lower(F.trim("p_name")).alias("norm"), F.lit(1).alias("rank")), F.struct(F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("norm"), F.lit(2).alias("rank")))).alias("x")).select("id", "x.*")
    q = p.select(F.lower(F.when(F.col("p_size") < 10, F.col("p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_name"))).alias("norm")).distinct()
    return q.join(names, "norm").groupBy("norm").agg(F.min("rank").alias("rank"), F.countDistinct("id").alias("n_entities"), F.min("id").alias("first_id"))


@query("""WITH m AS (SELECT p_partkey AS m, p_name, p_type, p_size FROM part), c AS (SELECT m, 1 AS rung, p_partkey AS cand FROM m JOIN part USING (p_name, p_type, p_size) UNION ALL SELECT m, 2, p_partkey FROM m JOIN part USING (p_type, p_size)), b AS (SELECT *, min(rung) OVER (PARTITION BY m) AS best FROM c WHERE cand <> m),
k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY cand) AS r FROM b WHERE rung = best) SELECT m, rung, cand, r AS place FROM k WHERE r <= 5""")
def candidate_ladder(s, d):
    from pyspark.sql import Window

    p = table(s, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    m = p.withColumnRenamed("p_partkey", "m")
    same = (["p_name", "p_type", "p_size"], ["p_type", "p_size"])
    one, two = (pairing.first_others(m, p, keys, "m", "p_partkey", 5).withColumn("rung", F.lit(rung)) for rung, keys in enumerate(same, 1))
    # later rungs only for mentions that earlier ones left with nothing
    two = two.join(one.select("m").distinct(), "m", "left_anti")
    w = Window.partitionBy("m").orderBy("cand")
    return one.unionByName(two).select("m", "rung", "cand").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5")


@query("SELECT a || b || c AS config, count(*) AS n FROM (VALUES ('0'), ('1')) x(a), (VALUES ('0'), ('1')) y(b), (VALUES ('0'), ('1')) z(c), part p WHERE (a = '0' OR p_size % 2 = 0) AND (b = '0' OR p_size > 10) AND (c = '0' OR p_retailprice > 905) GROUP BY 1")
def ablation_grid(s, d):
    flags = s.sql("SELECT concat(a, b, c) AS config, a = '1' AS a, b = '1' AS b, c = '1' AS c FROM VALUES ('0'), ('1') x(a) CROSS JOIN VALUES ('0'), ('1') y(b) CROSS JOIN VALUES ('0'), ('1') z(c)")
    p = table(s, d, "part")
    keep = (~F.col("a") | (F.col("p_size") % 2 == 0)) & (~F.col("b") | (F.col("p_size") > 10)) & (~F.col("c") | (F.col("p_retailprice") > 905))
    return p.join(F.broadcast(flags), keep).groupBy("config").agg(F.count("*").alias("n"))  # eight fixed rows


@query(f"WITH {AGG}, i AS (SELECT para, count(*) AS issues FROM score WHERE k % 3 = 0 GROUP BY para) SELECT para, aggregate, coalesce(issues, 0) AS issues, row_number() OVER (ORDER BY coalesce(aggregate, 0) DESC, coalesce(issues, 0), para) AS place FROM agg LEFT JOIN i USING (para)")
def ranking(s, d):
    a = scores.weighted(_latest(s, d), tables.criteria(s), ["para"])
    i = tables.scores(s, d).where("k % 3 = 0").groupBy("para").agg(F.count("*").alias("issues"))
    j = a.join(i, "para", "left").select("para", "aggregate", F.coalesce("issues", F.lit(0)).alias("issues"))
    return shaping.ranked(j, "aggregate", ["issues", "para"]).withColumn("place", F.col("place").cast("long"))


MARKED = "mk AS (SELECT p_partkey, '# ' || p_name || ' **' || p_type || '** [' || p_brand || '](http://x.org/a) `' || p_name || '` ![pic](a.png)' AS s FROM part)"


@query(f"""WITH {MARKED} SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '!\\[([^\\]]*)\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^#{{1,6}}[ \\t]+', '', 'g'), '(?m)^>[ \\t]?', '', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '`([^`]*)`', '\\1', 'g')) AS plain FROM mk""")
def strip_markdown(s, d):
    c = F.concat(F.lit("# "), "p_name", F.lit(" **"), "p_type", F.lit("** ["), "p_brand", F.lit("](http://x.org/a) `"), "p_name", F.lit("` ![pic](a.png)"))
    return table(s, d, "part").select("p_partkey", T.strip_markdown(c).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR length(p_name) > 10 THEN p_type ELSE p_name END AS lemma FROM part")
def lemma_fallback(s, d):
    lemma = F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise(" ")
    return table(s, d, "part").select("p_partkey", T.lemma_or_surface(lemma, F.col("p_type"), 10).alias("lemma"))


@query(f"WITH {SCORE}, {VERDICTS} SELECT crit, CASE WHEN guess IN ('green', 'yellow', 'red') THEN guess END AS verdict, count(*) AS n FROM v GROUP BY ALL")
def verdict_whitelist(s, d):
    return _verdicts(s, d).groupBy("crit", T.verdict(F.col("guess")).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(greatest(strlen(coalesce(text, '')), 1) AS BIGINT) AS n_tokens FROM documents")
def token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", F.greatest(F.octet_length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long").alias("n_tokens"))


@query("SELECT p_partkey, replace(replace('the [' || p_name || '] of [' || p_type || ']', '[' || p_name || ']', upper(p_name)), '[' || p_type || ']', upper(p_type)) AS text FROM part")
def glossary_rewrite(s, d):
    terms = F.array("p_name", "p_type")
    text = F.concat(F.lit("the ["), "p_name", F.lit("] of ["), "p_type", F.lit("]"))
    return table(s, d, "part").select("p_partkey", F.aggregate(terms, text, lambda a, t: F.replace(a, F.concat(F.lit("["), t, F.lit("]")), F.upper(t))).alias("text"))


@query("WITH p AS (SELECT p_name AS item, 1 AS prio FROM part WHERE p_size < 10 UNION ALL SELECT p_name, 2 FROM part WHERE p_retailprice > 1000 UNION ALL SELECT p_name, 3 FROM part) SELECT item, min(prio) AS pool FROM p GROUP BY item")
def priority_binding(s, d):
    p = table(s, d, "part")
    pool = F.when(F.col("p_size") < 10, 1).when(F.col("p_retailprice") > 1000, 2).otherwise(3)
    return p.groupBy(F.col("p_name").alias("item")).agg(F.min(pool).alias("pool"))


@query(f"WITH {WORDS} SELECT title, surface, min(idx) AS first_idx FROM gold GROUP BY title, surface")
def first_occurrence(s, d):
    return tables.mentions(s, d, "gold").groupBy("title", "surface").agg(F.min("idx").cast("long").alias("first_idx"))


@query(f"WITH {SCORE} SELECT id, first_value(kind) OVER (PARTITION BY para, crit ORDER BY ts, id) AS decision FROM score")
def decision_cache(s, d):
    v = tables.scores(s, d)
    first = v.groupBy("para", "crit").agg(F.min_by("kind", F.struct("ts", "id")).alias("decision"))
    return v.join(first, ["para", "crit"]).select("id", "decision")


@query(f"""WITH {SCORE}, {REV}, g AS (SELECT para, revision, max(aggregate) AS best FROM rev WHERE revision IS NOT NULL AND kind <> 'cache' GROUP BY ALL)
SELECT para, revision, best, best = max(best) OVER (PARTITION BY para) AS is_best, revision = max(revision) OVER (PARTITION BY para) AS is_newest FROM g""")
def revision_list(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("para")
    g = _revisions(s, d).where("revision is not null and kind <> 'cache'").groupBy("para", "revision").agg(F.max("aggregate").alias("best"))
    return g.select("para", "revision", "best", (F.col("best") == F.max("best").over(w)).alias("is_best"), (F.col("revision") == F.max("revision").over(w)).alias("is_newest"))


@query("SELECT a.doc_id, min(b.doc_id) AS found FROM documents a JOIN documents b ON a.text = b.text GROUP BY a.doc_id")
def exact_text_lookup(s, d):
    t = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("key")).where("key is not null")
    return t.join(t.groupBy("key").agg(F.min("doc_id").alias("found")), "key").groupBy("doc_id").agg(F.min("found").alias("found"))


@query("WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone)) GROUP BY l_orderkey")
def cascade_delete(s, d):
    gone = table(s, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    lost = table(s, d, "orders").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(s, d, "lineitem").select("l_orderkey").join(lost, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


@query(f"WITH {SCORE} SELECT id, round(least(value / 50 + 1.5, 10), 4) AS value FROM score WHERE kind = 'seed'")
def seed_uplift(s, d):
    return tables.scores(s, d).where("kind = 'seed'").select("id", F.round(F.least(F.col("value") / 50 + 1.5, F.lit(10.0)), 4).alias("value"))


@query("WITH m AS (SELECT p_partkey AS m, lower(p_name || CASE WHEN p_size < 25 THEN '' WHEN p_size < 40 THEN ' ' || p_brand ELSE ' of old' END) AS norm FROM part), n AS (SELECT norm, count(*) AS n, min(id) AS only_ FROM (SELECT lower(p_name) AS norm, p_partkey AS id FROM part UNION ALL SELECT lower(p_name || ' ' || p_brand), p_partkey FROM part) GROUP BY norm) SELECT m, CASE WHEN n = 1 THEN 'green' WHEN n > 1 THEN 'judge' ELSE 'red' END AS verdict, CASE WHEN n = 1 THEN only_ END AS entity FROM m LEFT JOIN n USING (norm)")
def grounding_ladder(s, d):
    p = table(s, d, "part")
    full = F.concat_ws(" ", "p_name", "p_brand")
    names = p.select("p_partkey", F.explode(F.array(F.lower("p_name"), F.lower(full))).alias("norm")).groupBy("norm").agg(F.count("*").alias("n"), F.min("p_partkey").alias("only"))
    said = F.when(F.col("p_size") < 25, F.col("p_name")).when(F.col("p_size") < 40, full).otherwise(F.concat("p_name", F.lit(" of old")))
    m = p.select(F.col("p_partkey").alias("m"), F.lower(said).alias("norm")).join(names, "norm", "left")
    return m.select("m", F.when(F.col("n") == 1, "green").when(F.col("n") > 1, "judge").otherwise("red").alias("verdict"), F.when(F.col("n") == 1, F.col("only")).alias("entity"))


@query("SELECT event_type, arg_min(event_id, (abs(value - 100), event_id)) AS event_id FROM events GROUP BY event_type")
def closest_pick(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.min_by("event_id", F.struct(F.abs(F.col("value") - 100), "event_id")).alias("event_id"))


@query()
def claim_longest_first(s, d):
    """Words of five letters and more of each turn, and pairs of them, claimed longest first; no SQL for a greedy choice."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)))
    pairs = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,} [A-Za-z]{5,}"), F.lit(0)))
    rows = table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text", F.concat(words, pairs).alias("surfaces"))
    return spans.claim(rows, "turn_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def type_counts(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, max(value) AS best FROM events GROUP BY user_id")
def paragraph_counts(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("best"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def scored_criteria(s, d):
    return table(s, d, "events").select("user_id", "event_type").distinct()


@query("SELECT lower(p_name) AS surface, min(CASE WHEN p_size < 25 THEN 0 ELSE 1 END) AS source FROM part GROUP BY 1")
def surface_union(s, d):
    p = table(s, d, "part")
    both = p.where("p_size < 25").select(F.lower("p_name").alias("surface"), F.lit(0).alias("source")).unionByName(p.where("p_size >= 25").select(F.lower("p_name").alias("surface"), F.lit(1).alias("source")))
    return both.groupBy("surface").agg(F.min("source").alias("source"))


@query(f"WITH {WORDS} SELECT title, count(DISTINCT c) AS n FROM (SELECT title, unnest(cands) AS c FROM pred) GROUP BY title")
def candidate_union(s, d):
    return tables.mentions(s, d, "pred").select("title", F.explode("cands").alias("c")).groupBy("title").agg(F.countDistinct("c").alias("n"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' WHEN length(text) > 2000 THEN 'too_long' WHEN len(string_split(text, chr(10))) > 12 THEN 'too_many' WHEN lang = 'en' THEN 'same_language' ELSE 'ok' END AS verdict FROM documents")
def document_validation(s, d):
    t = F.col("text")
    bad = [("blank", t.isNull() | (F.trim(t) == "")), ("too_long", F.length(t) > 2000), ("too_many", F.size(F.split(t, "\n")) > 12), ("same_language", F.col("lang") == "en")]
    return table(s, d, "documents").select("doc_id", rules.first_failing(bad).alias("verdict"))


@query("WITH c AS (SELECT event_id, 400 + CAST(floor(value) AS BIGINT) % 130 AS status FROM events) SELECT event_id, CASE WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server' WHEN status IN (401, 403) THEN 'auth' ELSE 'client' END AS reason, status >= 500 OR status = 429 AS transient FROM c")
def failure_reason(s, d):
    status = 400 + F.floor("value") % 130
    return table(s, d, "events").select("event_id", rules.reason(status).alias("reason"), rules.transient(status).alias("transient"))


@query(f"WITH {SCORE}, {ISSUES}, m AS (SELECT *, ['open', 'dismissed', 'outdated', 'accepted'][1 + id % 4] AS target FROM iss) SELECT id, CASE WHEN status <> 'accepted' AND target <> 'accepted' THEN target ELSE status END AS status FROM m")
def status_transition(s, d):
    k = F.col("k")
    status = F.when(k % 7 == 0, "accepted").when(k % 7 == 1, "dismissed").when(k % 7 == 2, "outdated").otherwise("open")
    target = F.get(F.array(*map(F.lit, ("open", "dismissed", "outdated", "accepted"))), (F.col("id") % 4).cast("int"))
    return tables.scores(s, d).where("k % 3 = 0").select("id", rules.move(status, target).alias("status"))


@query(f"WITH {SCORE} SELECT id, unnest(['seed', 'cache']) AS kind, value FROM score WHERE kind = 'live'")
def score_fan_out(s, d):
    return tables.scores(s, d).where("kind = 'live'").select("id", F.explode(F.array(F.lit("seed"), F.lit("cache"))).alias("kind"), "value")


@query("SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 2 GROUP BY user_id HAVING count(*) FILTER (WHERE value < 40) = 2")
def dead_routes(s, d):
    return rules.dead_starts(table(s, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], F.col("value") < 40)


@query("SELECT event_id, CASE WHEN greatest(value / 200, value / 150) >= 0.8 THEN 'red' WHEN greatest(value / 200, value / 150) >= 0.5 THEN 'yellow' ELSE 'green' END AS band FROM events")
def budget_band(s, d):
    return table(s, d, "events").select("event_id", rules.band(F.col("value") / 200, F.col("value") / 150).alias("band"))


@query("SELECT user_id, CASE WHEN count(DISTINCT event_type) = 5 THEN 'all' ELSE string_agg(DISTINCT event_type, '+' ORDER BY event_type) END AS roles FROM events GROUP BY user_id")
def role_usage(s, d):
    roles = F.array_sort(F.collect_set("event_type"))
    return table(s, d, "events").groupBy("user_id").agg(F.when(F.size(roles) == 5, "all").otherwise(F.array_join(roles, "+")).alias("roles"))


@query("SELECT doc_id, CASE WHEN len(l) > 1 THEN array_to_string([l[1] || ' ' || l[2]] || l[3:], '|') ELSE array_to_string(l, '|') END AS merged FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)")
def merged_up(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(rules.merge_up(F.split("text", "\n"), 1), "|").alias("merged"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents WHERE n_chars > 200) WHERE r <= 10")
def seeded_picks(s, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("7:"), "doc_id")), "doc_id"))
    return table(s, d, "documents").where("n_chars > 200").select("doc_id", "lang", rank.alias("r")).where("r <= 10").drop("r")


@query(f"WITH {LINES} SELECT doc_id, arg_max(idx, (length(line), -idx)) AS idx FROM lines GROUP BY doc_id")
def longest_paragraph(s, d):
    return tables.lines(s, d).groupBy("doc_id").agg(F.max_by("idx", F.struct(F.length("line"), -F.col("idx"))).alias("idx"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_repair(s, d):
    """props wrapped as a reply with a fence, a preface and a trailing comma, and read back."""
    raw = F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", r"\}\s*$", ",}"), F.lit("\n```"))
    return table(s, d, "events").select("event_id", F.get_json_object(rules.repair_json(raw), "$.k").alias("k"))


@query("WITH RECURSIVE w AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey < 4 UNION ALL SELECT p.p_partkey, w.depth + 1 FROM w JOIN part p ON p.p_partkey // 3 = w.node WHERE w.depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def category_walk(s, d):
    p = table(s, d, "part")
    edges = p.select(F.floor(F.col("p_partkey") / 3).alias("parent"), F.col("p_partkey").alias("child"))
    return rules.walk(edges, p.where("p_partkey < 4").select(F.col("p_partkey").alias("node")), 3)


# What pages link to: every third title has no page, every third of the rest no entity, every fifth entity is a date.
TITLE_MAP = "title string, canonical string, qid string, classes array<string>"


def _titles(found):
    h = F.xxhash64("title")
    t = found.where("title is not null").select("title").distinct().where(F.pmod(h, F.lit(3)) != 0)
    qid = F.when(F.pmod(h, F.lit(9)) != 1, F.concat(F.lit("Q"), F.crc32("title").cast("string")))
    return t.select("title", F.upper("title").alias("canonical"), qid.alias("qid"), F.when(F.pmod(h, F.lit(5)) == 0, F.array(F.lit("Q578"))).otherwise(F.array(F.lit("Q5"))).alias("classes"))


@query()
def page_anchors(s, d):
    """Links of pages as gold mentions, and those left out with the reason; no SQL for parsing HTML."""
    paragraphs = F.replace(F.regexp_replace("html", r"<(/?)li\b", "<$1p"), F.lit('href="/'), F.lit('href="./'))  # the lists of links as paragraphs
    found = anchors.found(table(s, d, "pages").withColumn("html", paragraphs), "page_id", "html")
    return anchors.resolved(found, _titles(found), "page_id")


@query()
def page_anchor_counters(s, d):
    return anchors.counters(page_anchors(s, d), "page_id")


@query()
def page_text(s, d):
    return anchors.flattened(table(s, d, "pages"), "page_id", "html")


@query()
def sentence_contexts(s, d):
    """The sentences around the first long word of each turn; no SQL for the rules of abbreviations."""
    t = table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text")
    at = F.regexp_instr("text", F.lit(r"\p{L}{9,}")) - 1
    t = t.select("turn_id", "text", at.alias("start"), (at + F.length(F.regexp_extract("text", r"\p{L}{9,}", 0))).alias("end")).where("start >= 0")
    return extraction.contexts(t).select("turn_id", "start", "context")


@query()
def reply_surfaces(s, d):
    """Surfaces in model replies, built around the words of parts, checked against the part's own words."""
    rows = table(s, d, "part").select("p_partkey", F.col("p_name").alias("source"), F.concat(F.lit('Sure: [{"surface": "'), F.split("p_name", " ")[0], F.lit('", "category": "place"}, {"surface": "none]", "category": "odd"}] done')).alias("reply"))
    return extraction.surfaces(rows, "p_partkey")


TIERS = "g AS (SELECT *, length(qid) % 4 = 0 AS off FROM gold)"


def _tiered(s, d):
    gold, pred = _mentions(s, d)
    return gold.withColumn("tier", F.when(F.length("qid") % 4 == 0, 1).otherwise(0)), pred


@query(f"""WITH {WORDS}, {TIERS}, gu AS (SELECT title, qid, bool_or(regexp_matches(surface, '^\\p{{Lu}}')) AS up, bool_and(regexp_matches(surface, '^\\p{{Lu}}')) AS al FROM g WHERE NOT off GROUP BY ALL),
pu AS (SELECT title, qid, bool_or(regexp_matches(surface, '^\\p{{Lu}}')) AS up FROM pred GROUP BY ALL),
c AS (SELECT CASE WHEN coalesce(a.up, b.up) THEN 'named' ELSE 'term' END AS class, a.qid IS NOT NULL AS ing, b.qid IS NOT NULL AS inp, coalesce(a.up AND NOT a.al, false) AS amb FROM gu a FULL JOIN pu b ON a.title = b.title AND a.qid = b.qid),
n AS (SELECT l.class, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (ing AND NOT inp) AS fn, count(*) FILTER (inp AND NOT ing) AS fp FROM (VALUES ('named'), ('term')) l(class) LEFT JOIN c USING (class) GROUP BY 1)
SELECT class, tp, fn, fp, tp + fn AS gold_units, (SELECT count(*) FROM c WHERE amb) AS n_ambiguous, (SELECT count(*) FROM g WHERE off) AS n_dropped_by_tier, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r_doc, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p_doc FROM n""")
def corpus_aggregate(s, d):
    return evaluation.corpus(*_tiered(s, d)).select("class", "tp", "fn", "fp", "gold_units", "n_ambiguous", "n_dropped_by_tier", "r_doc", "p_doc")


@query(f"""WITH {SCORE}, r AS (SELECT CASE k % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS gd, CASE k % 5 WHEN 2 THEN 'yellow' WHEN 3 THEN 'red' ELSE 'green' END AS pd, k % 7 AS gq, CASE WHEN k % 4 > 0 THEN k % 14 END AS pq, k % 6 AS calls FROM score)
SELECT count(*) AS n, count(*) FILTER (gd = 'green') AS n_green, count(*) FILTER (gd = 'yellow') AS n_yellow, count(*) FILTER (gd = 'red') AS n_red,
round(count(*) FILTER (gd <> 'red' AND pq = gq) / count(*) FILTER (gd <> 'red'), 4) AS qid_accuracy, round(count(*) FILTER (pd <> 'red') / count(*), 4) AS coverage, round(count(*) FILTER (gd = 'red' AND pd = 'red') / count(*) FILTER (gd = 'red'), 4) AS red_accuracy, round(avg(calls), 2) AS avg_api_calls FROM r""")
def grounding_score(s, d):
    k = F.col("k")
    colour = lambda x: F.when(x == 0, "green").when(x == 1, "yellow").otherwise("red")
    rows = tables.scores(s, d).select(colour(k % 3).alias("gold_difficulty"), F.when(k % 5 == 2, "yellow").when(k % 5 == 3, "red").otherwise("green").alias("pred_difficulty"), (k % 7).alias("gold_qid"), F.when(k % 4 > 0, k % 14).alias("pred_qid"), (k % 6).alias("n_api_calls"))
    return evaluation.grounding(rows)


@query(f"WITH {SCORE}, {VERDICTS}, l AS (SELECT unnest(['green', 'yellow', 'red']) AS label), c AS (SELECT label, count(*) FILTER (truth = label AND guess = label) AS tp, count(*) FILTER (truth = label) AS t, count(*) FILTER (guess = label) AS p FROM v, l GROUP BY label) SELECT label, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 4) AS precision, round(CASE WHEN t > 0 THEN tp / t ELSE 0 END, 4) AS recall, round(CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END, 4) AS f1 FROM c")
def label_scores(s, d):
    return evaluation.per_label(_verdicts(s, d), "truth", "guess", LABELS)


@query(f"WITH {SCORE}, {VERDICTS}, l AS (SELECT unnest(['green', 'yellow', 'red']) AS label), c AS (SELECT crit, label, count(*) FILTER (truth = label AND guess = label) AS tp, count(*) FILTER (truth = label) AS t, count(*) FILTER (guess = label) AS p FROM v, l GROUP BY crit, label) SELECT crit AS category, CAST(sum(t) AS BIGINT) AS n, round(avg(2 * tp / (t + p)) FILTER (t > 0), 4) AS macro_f1 FROM c GROUP BY crit")
def category_scores(s, d):
    return evaluation.per_category(_verdicts(s, d), "crit", "truth", "guess", LABELS)


@query("WITH g AS (SELECT DISTINCT o_orderpriority AS k, o_custkey * 3 AS x FROM orders), e AS (SELECT DISTINCT o_orderpriority AS k, o_custkey * 2 AS x FROM orders), j AS (SELECT coalesce(g.k, e.k) AS k, g.x AS gx, e.x AS ex FROM g FULL JOIN e ON g.k = e.k AND g.x = e.x), c AS (SELECT k, count(*) FILTER (gx = ex) AS tp, count(ex) AS n_extracted, count(gx) AS n_gold, list_sort(list(gx) FILTER (ex IS NULL)) AS missed, list_sort(list(ex) FILTER (gx IS NULL)) AS spurious FROM j GROUP BY k) SELECT k, tp, n_extracted, n_gold, round(tp / n_extracted, 4) AS precision, round(tp / n_gold, 4) AS recall, round(2 * tp / (n_extracted + n_gold), 4) AS f1, array_to_string(missed, ',') AS missed, array_to_string(spurious, ',') AS spurious FROM c")
def extraction_scores(s, d):
    o = table(s, d, "orders")
    gold = o.select(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") * 3).alias("x"))
    found = o.select(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") * 2).alias("x"))
    out = evaluation.extraction(found, gold, "k", "x")
    return out.withColumn("missed", F.array_join(F.col("missed").cast("array<string>"), ",")).withColumn("spurious", F.array_join(F.col("spurious").cast("array<string>"), ","))


@query(f"""WITH {WORDS}, x AS (SELECT DISTINCT title, idx, surface, qid, span FROM gold WHERE idx % 10 = 3), c AS (SELECT length(qid) % 4 = 0 AS tier, (title, idx, surface, qid, span) IN (SELECT (title, idx, surface, qid, span) FROM x) AS out FROM gold)
SELECT (SELECT count(*) FROM (SELECT DISTINCT title, qid FROM gold WHERE length(qid) % 4 <> 0 AND idx % 10 <> 3)) AS n_entities, count(*) FILTER (tier) AS n_dropped_by_tier, count(*) FILTER (NOT tier AND out) AS n_dropped_by_exclusion FROM c""")
def effective_gold(s, d):
    gold, _ = _tiered(s, d)
    return evaluation.gold_counts(gold, gold.where("idx % 10 = 3"))


ENTITY = "ent AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 > 0 THEN ['Q5', CASE p_size % 7 WHEN 0 THEN 'Q11424' WHEN 1 THEN 'Q578' WHEN 2 THEN 'Q207694' WHEN 3 THEN 'Q39911' ELSE 'Q571' END] END AS classes, CASE WHEN p_partkey % 11 > 0 AND p_size % 5 > 0 THEN p_partkey * 7 % 1500 - 500 END AS year FROM part)"


def _entities(s, d):
    k = F.col("p_size") % 7
    other = F.when(k == 0, "Q11424").when(k == 1, "Q578").when(k == 2, "Q207694").when(k == 3, "Q39911").otherwise("Q571")
    known = F.col("p_partkey") % 11 > 0
    return table(s, d, "part").select("p_partkey", "p_brand", F.when(known, F.array(F.lit("Q5"), other)).alias("classes"), F.when(known & (F.col("p_size") % 5 > 0), F.col("p_partkey") * 7 % 1500 - 500).alias("year"))


@query(f"WITH {ENTITY} SELECT p_partkey, coalesce(list_has_any(classes, ['Q11424', 'Q3305213', 'Q33506', 'Q207694']), false) OR coalesce(year >= 500, false) AS dropped FROM ent")
def relevance_gate(s, d):
    return _entities(s, d).select("p_partkey", decisions.gated(F.col("classes"), F.col("year")).alias("dropped"))


@query(f"WITH {ENTITY}, c AS (SELECT p_brand, coalesce(list_has_any(classes, ['Q3186692', 'Q39911', 'Q578', 'Q3311614', 'Q29964144', 'Q14795564', 'Q18340514']), false) AS x FROM ent) SELECT p_brand, count(*) FILTER (NOT x) AS n_kept, count(*) FILTER (x) AS n_excluded FROM c GROUP BY p_brand")
def chronology_filter(s, d):
    x = decisions.of_classes(F.col("classes"), decisions.CALENDAR)
    return _entities(s, d).groupBy("p_brand").agg(F.count_if(~x).alias("n_kept"), F.count_if(x).alias("n_excluded"))


@query("""WITH e AS (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN NULL WHEN 1 THEN 'INCORRECT ' || p_name WHEN 2 THEN p_name || ': mistranslated' WHEN 3 THEN 'an omitted ' || p_name WHEN 4 THEN 'Confusing' WHEN 5 THEN '' ELSE p_name END AS x FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(lower(coalesce(x, '')), 'incorrect|wrong|mistranslat|error|missing|omit|distort|confus') THEN 'major' ELSE 'minor' END AS severity FROM e""")
def issue_severity(s, d):
    k, n = F.col("p_size") % 9, F.col("p_name")
    x = F.when(k == 0, None).when(k == 1, F.concat(F.lit("INCORRECT "), n)).when(k == 2, F.concat(n, F.lit(": mistranslated"))).when(k == 3, F.concat(F.lit("an omitted "), n)).when(k == 4, "Confusing").when(k == 5, "").otherwise(n)
    return table(s, d, "part").select("p_partkey", decisions.severity(x).alias("severity"))


@query("""WITH t AS (SELECT p_partkey, replace(p_name, ' ', CASE p_size % 3 WHEN 0 THEN '] ' WHEN 1 THEN ' ' ELSE ' é - ' END) AS text, CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END AS n FROM part),
p AS (SELECT p_partkey, text, p_partkey % length(text) AS pos, substr(text, p_partkey % length(text) + 1, n) AS surface FROM t),
g AS (SELECT *, CASE WHEN pos > 0 THEN substr(text, pos, 1) ELSE '' END AS a, substr(text, pos + 1 + length(surface), 1) AS b FROM p)
SELECT p_partkey, length(trim(surface)) = 1 AND (regexp_matches(a, '[\\p{L}\\p{N}\\p{M}()\\[\\]{}⟨⟩«»<>]') OR regexp_matches(b, '[\\p{L}\\p{N}\\p{M}()\\[\\]{}⟨⟩«»<>]')) AS is_fragment FROM g""")
def symbol_fragment(s, d):
    k = F.col("p_size") % 3
    by = F.when(k == 0, "] ").when(k == 1, " ").otherwise(" é - ")
    t = table(s, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), by).alias("text"), F.when(F.col("p_size") % 5 == 0, 2).otherwise(1).alias("n"))
    t = t.withColumn("pos", (F.col("p_partkey") % F.length("text")).cast("int")).withColumn("surface", F.substr("text", F.col("pos") + 1, F.col("n")))
    return t.select("p_partkey", decisions.fragment(F.col("text"), F.col("pos"), F.col("surface")).alias("is_fragment"))


TERMS = """term AS (SELECT p_partkey, p_brand, CASE p_size % 10 WHEN 0 THEN 'exact_label' WHEN 1 THEN 'label_match' WHEN 2 THEN 'llm_disambiguation' WHEN 3 THEN 'llm_rejected' WHEN 4 THEN 'judge_unavailable' WHEN 5 THEN 'no_candidates' WHEN 6 THEN 'other' WHEN 7 THEN '' END AS way, p_partkey % 4 = 0 AS bare, CASE WHEN p_partkey % 3 > 0 THEN 'Q' || p_size ELSE '' END AS qid, p_partkey // 5 % 3 AS n FROM part),
toned AS (SELECT p_partkey, p_brand, CASE WHEN way IN ('exact_label', 'label_match') THEN 'det' WHEN way = 'llm_disambiguation' THEN 'llm' WHEN way IN ('llm_rejected', 'judge_unavailable') THEN 'rej' WHEN way = 'no_candidates' THEN 'none' WHEN way <> '' THEN CASE WHEN n > 0 THEN 'rej' ELSE 'none' END
WHEN bare THEN CASE WHEN qid <> '' THEN 'det' ELSE 'none' END WHEN qid <> '' THEN ['none', 'det', 'llm'][n + 1] ELSE CASE WHEN n > 0 THEN 'rej' ELSE 'none' END END AS tone FROM term)"""
WAYS = ("exact_label", "label_match", "llm_disambiguation", "llm_rejected", "judge_unavailable", "no_candidates", "other", "")


def _toned(s, d):
    way = F.get(F.array(*[F.lit(w) for w in WAYS]), F.col("p_size") % 10)
    qid = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("Q"), F.col("p_size").cast("string"))).otherwise("")
    tone = decisions.badge(way, F.col("p_partkey") % 4 == 0, qid, F.floor(F.col("p_partkey") / 5) % 3)
    return table(s, d, "part").select("p_partkey", "p_brand", tone.alias("tone"))


@query(f"WITH {TERMS} SELECT p_partkey, tone FROM toned")
def term_badge(s, d):
    return _toned(s, d).select("p_partkey", "tone")


@query(f"WITH {TERMS}, g AS (SELECT p_brand, count(*) AS n, arg_min(tone, p_partkey) AS t FROM toned GROUP BY p_brand) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_mentions, count(*) FILTER (t = 'det') AS n_det, count(*) FILTER (t = 'llm') AS n_llm, count(*) FILTER (t IN ('rej', 'none')) AS n_not_grounded FROM g")
def group_summary(s, d):
    return decisions.group_summary(_toned(s, d), "p_brand", "p_partkey", "tone")


@query(f"WITH {AGG} SELECT para, CASE WHEN aggregate >= 8 THEN 'green' WHEN aggregate >= 6 THEN 'yellow' ELSE 'red' END AS band FROM agg")
def score_band(s, d):
    return scores.weighted(_latest(s, d), tables.criteria(s), ["para"]).select("para", decisions.score_band(F.col("aggregate")).alias("band"))


@query(f"WITH {AGG} SELECT para % 20 AS doc, floor(CAST(sum(CAST(aggregate AS DECIMAL(18, 2))) AS DOUBLE) / count(*) * 10 + 0.5) / 10 AS aggregate FROM agg GROUP BY 1")
def client_aggregate(s, d):
    a = scores.weighted(_latest(s, d), tables.criteria(s), ["para"])
    return a.groupBy((F.col("para") % 20).alias("doc")).agg(decisions.half_up(F.sum(F.col("aggregate").cast("decimal(18,2)")).cast("double") / F.count("aggregate")).alias("aggregate"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber AS route, l_suppkey % 5 = 0 AS dead, CAST(l_quantity AS INT) % 4 AS n_success, 1 - 2 * l_discount AS success_rate, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 4 < 3 END AS honest, CASE WHEN l_partkey % 3 > 0 THEN l_tax END AS cost, CASE WHEN l_suppkey % 7 > 0 THEN l_quantity END AS latency FROM lineitem),
t AS (SELECT *, NOT dead AND n_success > 0 AS live, CASE WHEN honest AND success_rate >= 0.9 THEN 0 WHEN honest THEN 1 ELSE 2 END AS relaxed FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY live DESC, relaxed, cost NULLS LAST, latency NULLS LAST, route) AS n FROM t)
SELECT l_orderkey, CASE WHEN live THEN route END AS route, CASE WHEN live THEN relaxed END AS relaxed FROM b WHERE n = 1""")
def route_choice(s, d):
    q, p, u = F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey")
    r = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("route"), (u % 5 == 0).alias("dead"), (q.cast("int") % 4).alias("n_success"), (1 - 2 * F.col("l_discount")).alias("success_rate"), F.when(p % 4 > 0, p % 4 < 3).alias("honest"), F.when(p % 3 > 0, F.col("l_tax")).alias("cost"), F.when(u % 7 > 0, q).alias("latency"))
    return decisions.choose_route(r, "l_orderkey")


@query("""WITH j AS (SELECT p_partkey, [NULL, 'running', 'failed', 'done'][p_partkey % 4 + 1] AS tr, [NULL, 'skipped', 'running', 'stopped', 'done'][p_size % 5 + 1] AS pre, ['none', 'running', 'done', 'failed', NULL][p_partkey // 4 % 5 + 1] AS te FROM part)
SELECT p_partkey, CASE WHEN tr = 'running' THEN false WHEN tr = 'failed' THEN true WHEN pre = 'running' THEN false ELSE coalesce(te IN ('done', 'failed'), false) END AS ended, coalesce(tr, 'done') = 'done' AND coalesce(pre, '') <> 'stopped' AND coalesce(te, '') = 'done' AS succeeded FROM j""")
def job_state(s, d):
    pick = lambda names, i: F.get(F.array(*[F.lit(n).cast("string") for n in names]), i.cast("int"))
    p = F.col("p_partkey")
    parts = pick((None, "running", "failed", "done"), p % 4), pick((None, "skipped", "running", "stopped", "done"), F.col("p_size") % 5), pick(("none", "running", "done", "failed", None), F.floor(p / 4) % 5)
    return table(s, d, "part").select("p_partkey", decisions.ended(*parts).alias("ended"), decisions.succeeded(*parts).alias("succeeded"))


@query(f"WITH {LINES} SELECT doc_id, idx, row_number() OVER (ORDER BY doc_id, idx) - 1 AS n FROM lines")
def global_paragraph_index(s, d):
    return decisions.enumerate_all(tables.lines(s, d).select("doc_id", "idx"), "doc_id", "idx", "n")


@query(f"WITH {SCORE}, {ISSUES} SELECT id, para, crit FROM iss i WHERE status = 'open' AND (kind = 'live' OR kind = 'seed' AND NOT EXISTS (SELECT 1 FROM score s WHERE s.kind = 'live' AND s.para = i.para AND s.crit = i.crit))")
def open_findings(s, d):
    return scores.visible(_issues(s, d), tables.scores(s, d)).where("status = 'open'").select("id", "para", "crit")


FULL = "CASE p_size % 4 WHEN 0 THEN p_name || ' of ' || p_brand WHEN 1 THEN p_name || ', the ' || p_type WHEN 2 THEN p_name || ' IV' ELSE p_name END"


@query(f"""WITH n AS (SELECT p_partkey, p_type, p_brand, {FULL} AS name, p_size % 5 > 0 AS has FROM part), s AS (SELECT *, trim(regexp_replace(trim(string_split_regex(name, '\\s+(?:of|the|son|daughter|and)\\s+|,\\s*')[1]), '\\s+(?:[IVXLC]+|[A-Z])$', '')) AS short FROM n)
SELECT p_partkey, CASE WHEN has THEN name || '|' || p_type || '|' || p_brand || CASE WHEN short <> name THEN '|' || short ELSE '' END ELSE p_type || '|' || name || '|' || p_brand END AS forms FROM s""")
def entity_forms(s, d):
    k = F.col("p_size") % 4
    name = F.when(k == 0, F.concat("p_name", F.lit(" of "), "p_brand")).when(k == 1, F.concat("p_name", F.lit(", the "), "p_type")).when(k == 2, F.concat("p_name", F.lit(" IV"))).otherwise(F.col("p_name"))
    value = lambda c: F.concat(F.lit('{"value":"'), c, F.lit('"}'))
    label = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit('"labels":{"en":'), value(name), F.lit("},"))).otherwise("")
    json = F.concat(F.lit("{"), label, F.lit('"aliases":{"en":['), value(F.col("p_type")), F.lit(',{"value":"𒋀"},'), value(name), F.lit(']},"sitelinks":{"enwiki":{"title":"'), F.col("p_brand"), F.lit('"}}}'))
    return table(s, d, "part").select("p_partkey", F.array_join(forms.latin_forms(forms.entity(json)), "|").alias("forms"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN '' ELSE p_brand || '|' || p_type END AS names FROM part")
def alternate_names(s, d):
    k, name, brand = F.col("p_size") % 3, F.col("p_name"), F.col("p_brand")
    twice = F.concat(F.lit("the "), name, F.lit(" and "), name, F.lit(" ("), brand, F.lit(", или "), F.col("p_type"), F.lit(") x (no)"))
    context = F.when(k == 0, twice).when(k == 1, F.concat(name, F.lit(" x ("), brand, F.lit(")"))).otherwise(F.concat(name, F.lit("("), brand, F.lit(" или "), F.col("p_type"), F.lit(",)")))
    return table(s, d, "part").select("p_partkey", F.array_join(forms.alternates(name, context), "|").alias("names"))


INFLECTED = ("Тигра", "мирами", "дом", "Среднем", "линия", "яя", "городах", "синий")


@query(f"""WITH w AS (SELECT p_partkey, i, lower([{", ".join(f"'{w}'" for w in INFLECTED)}][i]) AS w, o FROM (SELECT p_partkey, unnest([p_size % 8 + 1, p_partkey % 8 + 1]) AS i, unnest([1, 2]) AS o FROM part)),
c AS (SELECT *, list_filter([{", ".join(f"'{e}'" for e in forms.CASE_ENDINGS)}], lambda e: ends_with(w, e) AND length(w) - length(e) >= 3)[1] AS e FROM w)
SELECT p_partkey, string_agg(CASE WHEN length(w) > 4 AND e IS NOT NULL THEN substr(w, 1, length(w) - length(e)) ELSE w END, ' ' ORDER BY o) AS stem FROM c GROUP BY p_partkey""")
def phrase_stems(s, d):
    pick = lambda i: F.get(F.array(*map(F.lit, INFLECTED)), i.cast("int"))
    return table(s, d, "part").select("p_partkey", forms.stems(F.concat_ws("  ", pick(F.col("p_size") % 8), pick(F.col("p_partkey") % 8))).alias("stem"))


@query("SELECT p_partkey, array_to_string(list_filter(range(length(p_name)), lambda i: substr(p_name, i + 1, length(f)) = f), ',') AS places FROM (SELECT p_partkey, p_name || p_name AS p_name, substr(p_name, 2, 1 + p_size % 2) AS f FROM part)")
def fragment_places(s, d):
    f = F.substr("p_name", F.lit(2), 1 + F.col("p_size") % 2)
    return table(s, d, "part").select("p_partkey", F.array_join(forms.occurrences(F.concat("p_name", "p_name"), f).cast("array<string>"), ",").alias("places"))


@query("""WITH t AS (SELECT p_partkey, p_size % 3 AS k, p_name, '=' || p_type AS p_type, p_brand FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN p_type || '!' WHEN 1 THEN p_name || '.' END AS sentence, CASE k WHEN 0 THEN p_name || '. ' WHEN 1 THEN '' END AS before, CASE k WHEN 0 THEN p_type WHEN 1 THEN p_name END AS match, CASE k WHEN 0 THEN '!  ' || p_brand || ' end' WHEN 1 THEN '. ' || p_type || '!  ' || p_brand || ' end' END AS after FROM t""")
def sentence_of_match(s, d):
    k = F.col("p_size") % 3
    text = F.concat("p_name", F.lit(". ="), "p_type", F.lit("!  "), "p_brand", F.lit(" end"))
    needle = F.when(k == 0, F.concat(F.lit("="), F.lower("p_type"))).when(k == 1, F.upper("p_name")).otherwise("zzz")
    return table(s, d, "part").select("p_partkey", forms.sentence_with(text, needle).alias("sentence"), forms.match_span(text, needle).alias("m")).select("p_partkey", "sentence", "m.before", "m.match", "m.after")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || ' new ' || p_brand WHEN 1 THEN p_name || ' new ' || p_brand WHEN 2 THEN p_name || ' X' END AS target FROM part")
def suggestion_splice(s, d):
    k = F.col("p_size") % 4
    fragment = F.when(k < 2, F.col("p_type")).when(k == 2, F.concat_ws("  ", "p_type", "p_brand")).otherwise("nothing like it")
    said = F.when(k == 0, F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit(" new"))).when(k == 1, F.concat(F.lit("new "), F.lower("p_brand"))).otherwise("X")
    return table(s, d, "part").select("p_partkey", forms.spliced(F.concat_ws(" ", "p_name", "p_type", "p_brand"), fragment, said).alias("target"))


PEOPLES = ("царь", "Ур", "Урук", "халдеи", "шумерцы", "бойцы", "Горцы", "самаряне", "цари", "инане")
LEXICON = (("царь", "role"), ("Ур", "place"), ("халдеи", "people"), ("Ур", "other"))


@query(f"""WITH w AS (SELECT p_partkey, [v[p_size % 10 + 1], v[p_partkey % 10 + 1], v[p_partkey // 10 % 10 + 1]] AS ws FROM (SELECT *, [{", ".join(f"'{w}'" for w in PEOPLES)}] AS v FROM part))
SELECT p_partkey, array_to_string(list_concat(list_filter(['царь', 'Ур', 'халдеи'], lambda f: list_contains(ws, f)), list_filter(ws, lambda x, i: list_position(ws, x) = i AND x IN ('шумерцы', 'самаряне'))), ',') AS surfaces,
array_to_string(list_transform(list_concat(list_filter(['царь', 'Ур', 'халдеи'], lambda f: list_contains(ws, f)), list_filter(ws, lambda x, i: list_position(ws, x) = i AND x IN ('шумерцы', 'самаряне'))), lambda x: CASE x WHEN 'царь' THEN 'role' WHEN 'Ур' THEN 'place' ELSE 'people' END), ',') AS categories FROM w""")
def gazetteer_surfaces(s, d):
    pick = lambda i: F.get(F.array(*map(F.lit, PEOPLES)), i.cast("int"))
    p = F.col("p_partkey")
    text = F.concat(pick(F.col("p_size") % 10), F.lit(", "), pick(p % 10), F.lit(" и "), pick(F.floor(p / 10) % 10), F.lit("."))
    found = table(s, d, "part").select("p_partkey", forms.gazetteer(text, LEXICON).alias("g"))
    return found.select("p_partkey", F.array_join("g.surface", ",").alias("surfaces"), F.array_join("g.category", ",").alias("categories"))


@query("""WITH p AS (SELECT p_partkey, length(p_name) AS n, length(split_part(p_name, ' ', 1)) AS a FROM part)
SELECT p_partkey, a + 1 AS start, n AS "end", 1 AS place FROM p UNION ALL SELECT p_partkey, n + 1, 2 * n + 1, 2 FROM p UNION ALL SELECT p_partkey, 0, a, 4 FROM p""")
def claims_in_turn(s, d):
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    rows = table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_name").alias("text"), F.array(word(2), F.col("p_name"), F.lit(None).cast("string"), word(1), F.col("p_name")).alias("surfaces"))
    return spans.claim_in_turn(rows, "p_partkey")


@query("""WITH p AS (SELECT p_partkey, length(p_name) AS n FROM part) SELECT p_partkey, 0 AS start, n - 1 AS "end", 2 AS place, NULL AS host FROM p UNION ALL SELECT p_partkey, 0, 2, 3, 2 FROM p""")
def nested_ranges(s, d):
    n = F.length("p_name")
    r = lambda a, b: F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"))
    ranges = F.array(r(1, 3), r(0, n - 1), r(0, 2), r(n - 2, n), r(n - 1, n), r(n, n + 1))
    return spans.show(table(s, d, "part").select("p_partkey", F.col("p_name").alias("text"), ranges.alias("ranges")), "p_partkey")


@query("""WITH p AS (SELECT p_partkey, p_name, length(p_name) AS n, least(p_size % 4, length(split_part(p_name, ' ', 2)) - 1) AS cut, p_size % 7 = 0 AS lost FROM part), v AS (SELECT *, 2.0 * (n - cut) / (2 * n - cut) AS sim FROM p),
t AS (SELECT *, CASE WHEN lost THEN 'red' WHEN cut = 0 OR sim >= 0.9 THEN 'green' WHEN sim >= 0.7 THEN 'yellow' ELSE 'red' END AS verdict FROM v)
SELECT p_partkey, verdict, CASE WHEN verdict <> 'red' THEN substr(p_name, 1, n - cut) END AS surface, CASE WHEN verdict <> 'green' THEN p_name END AS recommended FROM t""")
def fuzzy_pairs(s, d):
    cut = F.least(F.col("p_size") % 4, F.length(F.split_part("p_name", F.lit(" "), F.lit(2))) - 1)
    target = F.when(F.col("p_size") % 7 == 0, "§§ §§ §§").otherwise(F.concat(F.lit("§§ "), F.substr("p_name", F.lit(1), F.length("p_name") - cut), F.lit(" §§")))
    out = pairing.pair(table(s, d, "part"), F.array("p_name"), target, "x")
    return out.select("p_partkey", "x.verdict", "x.surface", "x.recommended")


@query("""WITH known AS (SELECT DISTINCT lower(p_type) AS norm, 'about ' || p_type AS context FROM part), m AS (SELECT p_partkey, p_name, p_size, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN '' END AS context, CASE WHEN p_size % 4 = 1 THEN lower(p_type) END AS norm, CASE WHEN p_size % 4 = 2 THEN repeat('x', p_size) || ' ' || p_name || ' tail ' || p_type ELSE 'none' END AS source FROM part),
j AS (SELECT m.* EXCLUDE (context), nullif(m.context, '') AS own, k.context AS got, strpos(source, p_name) AS found FROM m LEFT JOIN known k USING (norm))
SELECT p_partkey, coalesce(own, got, CASE WHEN found > 0 THEN substr(source, greatest(1, found - 40), found - greatest(1, found - 40) + length(p_name) + 40) END, '') AS context, CASE WHEN own IS NOT NULL THEN 'golden' WHEN got IS NOT NULL THEN 'golden_source' WHEN found > 0 THEN 'reconstructed' ELSE 'unavailable' END AS origin,
CASE WHEN own IS NOT NULL THEN p_partkey WHEN got IS NOT NULL THEN p_partkey WHEN found > 0 THEN found - 1 ELSE -1 END AS start, CASE WHEN own IS NULL AND got IS NULL AND found > 0 THEN found - 1 + length(p_name) ELSE -1 END AS "end" FROM j""")
def mention_contexts(s, d):
    p, k = table(s, d, "part"), F.col("p_size") % 4
    known = p.select(F.lower("p_type").alias("norm"), F.concat(F.lit("about "), "p_type").alias("context")).distinct()
    none = F.lit(None).cast("string")
    m = p.select("p_partkey", F.col("p_name").alias("surface"), none.alias("norm_surface"), F.when(k == 1, F.lower("p_type")).alias("norm_lemma"), F.when(k == 0, F.col("p_brand")).when(k == 1, "").alias("context"), F.col("p_partkey").alias("para"), F.col("p_partkey").alias("start"), F.lit(None).cast("long").alias("end"))
    source = F.when(k == 2, F.concat(F.expr("repeat('x', p_size)"), F.lit(" "), "p_name", F.lit(" tail "), "p_type")).otherwise("none")
    return lookups.contexts(m, known, p.select(F.col("p_partkey").alias("para"), source.alias("source"))).select("p_partkey", "context", "origin", "start", "end")


@query("""WITH t AS (SELECT p_partkey AS n, CASE WHEN p_size % 3 = 0 THEN 't' ELSE 'T' END || p_partkey AS title FROM part), c AS (SELECT title, CASE WHEN n % 17 = 4 THEN n - 1 ELSE n END AS n FROM t)
SELECT title, CASE WHEN p_size % 11 = 0 THEN 'missing' WHEN p_size % 5 = 0 THEN 'no_entity' ELSE 'entity' END AS state, CASE WHEN p_size % 11 > 0 THEN 'T' || n END AS canonical, CASE WHEN p_size % 11 > 0 AND p_size % 5 > 0 THEN 'Q' || n END AS qid FROM c JOIN part ON p_partkey = n""")
def title_entities(s, d):
    p, n = table(s, d, "part"), F.col("p_partkey")
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    titles = p.select(F.when(F.col("p_size") % 3 == 0, name("t", n)).otherwise(name("T", n)).alias("title"))
    normalized = p.select(name("t", n).alias("src"), name("T", n).alias("dst"))
    redirects = p.select(name("T", n).alias("src"), F.when(n % 17 == 4, name("T", n - 1)).alias("dst"))
    pages = p.select(name("T", n).alias("canonical"), F.when(F.col("p_size") % 5 > 0, name("Q", n)).alias("qid"), (F.col("p_size") % 11 == 0).alias("missing"))
    return lookups.entities_of(titles, normalized, redirects, pages)


@query("""WITH c AS (SELECT p_name AS surface, max(p_brand) AS target, CASE WHEN max(p_size) % 3 > 0 THEN 'red' END AS verdict FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN verdict IS NULL THEN p_type WHEN length(target) % 2 = 0 THEN target END AS target, coalesce(verdict, 'green') AS verdict, CASE WHEN verdict IS NULL THEN 'say it' END AS recommended FROM part JOIN c ON surface = p_name""")
def verdict_overlay(s, d):
    p = table(s, d, "part")
    c = p.groupBy(F.col("p_name").alias("surface")).agg(F.max("p_brand").alias("t"), F.max("p_size").alias("z"))
    c = c.select("surface", F.when(F.length("t") % 2 == 0, F.col("t")).alias("target"), F.when(F.col("z") % 3 > 0, "red").alias("verdict"), F.lit(None).cast("string").alias("recommended"))
    t = p.select("p_partkey", F.col("p_name").alias("surface"), F.col("p_type").alias("target"), F.lit("green").alias("verdict"), F.lit("say it").alias("recommended"))
    return lookups.overlaid(t, c).drop("surface")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 48 THEN 'max_tokens' WHEN l_tax > 0.07 THEN 'reasoning' WHEN l_discount > 0.09 THEN 'temperature' WHEN l_quantity < 5 THEN 'zoom' END AS bad FROM lineitem""")
def parameter_check(s, d):
    q = F.col("l_quantity")
    pairs = {"max_tokens": F.when(q > 48, "32769").otherwise(q.cast("int").cast("string")), "temperature": F.when(F.col("l_discount") > 0.09, "2.5").otherwise(F.col("l_discount").cast("string")), "reasoning": F.when(F.col("l_tax") > 0.07, '{"effort":"most"}').otherwise('{"effort":"low","max_tokens":9}'), "enable_thinking": F.lit("true")}
    known = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    params = F.when(q < 5, F.map_concat(known, F.create_map(F.lit("zoom"), F.lit("1")))).otherwise(known)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", lookups.first_bad_parameter(params).alias("bad"))


@query(f"""WITH {WORDS}, p AS (SELECT title, qid, length(qid) % 3 > 0 AS clean FROM pred WHERE length(qid) % 7 <> 0), g AS (SELECT count(*) AS n_grounded, count(*) FILTER (NOT clean) AS n_tainted FROM p), h AS (SELECT title, qid, bool_or(clean) AS clean FROM p GROUP BY ALL),
n AS (SELECT count(*) AS n_gold, count(h.qid) AS matched, count(*) FILTER (clean) AS matched_clean FROM gold LEFT JOIN h USING (title, qid))
SELECT n_gold, n_grounded, n_tainted, round(n_tainted / n_grounded, 4) AS tainted_share, matched, matched_clean, round(matched / n_gold, 4) AS recall, round(matched_clean / n_gold, 4) AS recall_clean, round((matched_clean - matched) / n_gold, 4) AS delta, matched - matched_clean AS n_lost FROM n, g""")
def contamination_replay(s, d):
    n = F.length("qid")
    p = tables.mentions(s, d, "pred").select("title", F.when(n % 7 != 0, F.col("qid")).alias("qid"), F.when(n % 3 == 0, "sitelink").otherwise("label").alias("source"))
    return evaluation.contamination(tables.mentions(s, d, "gold"), p, "sitelink")


GRID = """u AS (SELECT l_linestatus, 'quantity' AS criterion, l_quantity AS x, * FROM lineitem UNION ALL SELECT l_linestatus, 'discount', l_discount, * FROM lineitem), v AS (SELECT l_linestatus, criterion, x, 'tax' AS metric, CASE WHEN l_tax < 0.08 THEN l_tax END AS y FROM u UNION ALL SELECT l_linestatus, criterion, x, 'price', l_extendedprice FROM u),
r AS (SELECT l_linestatus, criterion, metric, rank() OVER (PARTITION BY l_linestatus, criterion, metric ORDER BY x) + (count(*) OVER (PARTITION BY l_linestatus, criterion, metric, x) - 1) / 2 AS a, rank() OVER (PARTITION BY l_linestatus, criterion, metric ORDER BY y) + (count(*) OVER (PARTITION BY l_linestatus, criterion, metric, y) - 1) / 2 AS b FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
grid AS (SELECT l_linestatus, criterion, metric, count(*) AS n, round(corr(a, b), 4) AS rho FROM r GROUP BY ALL)"""


def _grid(s, d):
    li = table(s, d, "lineitem").select("l_linestatus", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.when(F.col("l_tax") < 0.08, F.col("l_tax")).alias("tax"), F.col("l_extendedprice").alias("price"))
    return stats.spearman_grid(li, "l_linestatus", ["quantity", "discount"], ["tax", "price"])


@query(f"WITH {GRID} SELECT * FROM grid")
def correlation_grid(s, d):
    return _grid(s, d)


@query(f"WITH {GRID}, m AS (SELECT metric, round(avg(abs(rho - 0.25)), 4) AS mean_abs FROM grid GROUP BY metric) SELECT metric, mean_abs, row_number() OVER (ORDER BY mean_abs, metric) = 1 AS best FROM m")
def nearest_variant(s, d):
    cells = _grid(s, d)
    keys = ["l_linestatus", "criterion", "metric"]
    targets = cells.select(*keys, F.lit(0.25).alias("target"))
    return evaluation.nearest(evaluation.residuals(cells, targets, keys), "metric")


@query("""WITH q AS (SELECT l_returnflag, CASE WHEN l_tax > 0 THEN l_quantity END AS v FROM lineitem), n AS (SELECT l_returnflag, v, count(*) AS c FROM q WHERE v IS NOT NULL GROUP BY ALL)
SELECT l_returnflag, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_distinct, arg_max(v, (c, -v)) AS modal, round(max(c) / sum(c), 4) AS modal_share, round(coalesce(sum(c) FILTER (v IN (9, 10)), 0) / sum(c), 4) AS top_share, round(CAST(sum(CAST(v AS DECIMAL(18, 6)) * c) AS DOUBLE) / sum(c), 4) AS mean FROM n GROUP BY 1""")
def tie_summary(s, d):
    return stats.tie_summary(table(s, d, "lineitem").select("l_returnflag", F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("v")), "l_returnflag", "v")


@query("""WITH c AS (SELECT l_suppkey, l_discount < 0.095 AS ok, CAST(l_quantity AS DOUBLE) AS lat, CASE WHEN l_suppkey % 4 > 0 THEN CAST(l_quantity * 4 AS INT) END AS pt, CAST(l_quantity AS INT) AS ct, CASE WHEN l_suppkey % 3 = 0 THEN l_tax END AS cost, CASE WHEN l_suppkey % 2 = 0 THEN 0.3 END AS price, l_suppkey % 9 = 0 AS dead FROM lineitem),
p AS (SELECT l_suppkey, lat, ok, row_number() OVER (PARTITION BY l_suppkey, ok ORDER BY lat) AS r, count(*) OVER (PARTITION BY l_suppkey, ok) AS n FROM c), p90 AS (SELECT l_suppkey, coalesce(max(lat) FILTER (ok AND r = (9 * n + 9) // 10), max(lat)) AS latency_p90, count(*) FILTER (ok) AS good FROM p GROUP BY 1),
a AS (SELECT l_suppkey, count(*) AS n_calls, count(*) FILTER (ok) AS n_success, bool_or(dead) AS dead, coalesce(median(lat) FILTER (ok), median(lat)) AS latency_median, median(pt) FILTER (ok) AS prompt_median, median(ct) FILTER (ok) AS completion_median, median(cost) FILTER (ok) AS told, max(price) AS price FROM c GROUP BY 1),
b AS (SELECT *, (prompt_median * price + completion_median * price) / 1000000 AS guess, n_success / n_calls AS rate FROM a JOIN p90 USING (l_suppkey))
SELECT l_suppkey, n_calls, n_success, round(rate, 6) AS success_rate, latency_median, CASE WHEN n_success > 0 THEN latency_p90 END AS latency_p90, prompt_median, completion_median, round(coalesce(told, guess), 9) AS cost, CASE WHEN told IS NOT NULL THEN 'real' WHEN guess IS NOT NULL THEN 'estimated' ELSE 'unknown' END AS cost_source, prompt_median <= 100 AS honest, dead,
CASE WHEN dead THEN 'dead' WHEN n_success = 0 THEN 'failed' WHEN rate < 0.9 THEN 'unstable' WHEN prompt_median > 100 THEN 'padded' WHEN prompt_median IS NULL THEN 'unknown-tokens' ELSE 'candidate' END AS verdict FROM b""")
def route_statistics(s, d):
    k, q = F.col("l_suppkey"), F.col("l_quantity")
    price = F.when(k % 2 == 0, 0.3)
    calls = table(s, d, "lineitem").select("l_suppkey", (F.col("l_discount") < 0.095).alias("ok"), q.cast("double").alias("latency"), F.when(k % 4 > 0, (q * 4).cast("int")).alias("prompt_tokens"), q.cast("int").alias("completion_tokens"), F.when(k % 3 == 0, F.col("l_tax")).alias("cost"), price.alias("price_in"), price.alias("price_out"), (k % 9 == 0).alias("dead"))
    out = decisions.route_stats(calls, ["l_suppkey"])
    return out.withColumns({"success_rate": F.round("success_rate", 6), "cost": F.round("cost", 9), "latency_p90": F.when(F.col("n_success") > 0, F.col("latency_p90"))})


from lexigauge.plans import evaluation_more, grounding, rules_more, store_more, store_rows  # noqa: E402, F401  they register their queries

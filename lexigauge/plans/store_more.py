"""Queries of the score store beyond views: edits, blocks of Markdown, migrations, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigauge.operators import blocks, edits, migration, reports
from lexigauge.plans.registry import query
from lexigauge.sources.tables import table

# Lines of documents in Markdown's kinds, by document and line.
KINDS = ("# ", "- ", "12. ", "| a ", "", "[^n1]: ", "", "## ", "")
LINE = " ".join(f"WHEN {i} THEN '{k}' || line" + (" || ' |'" if k.startswith("|") else "") for i, k in enumerate(KINDS))
MARKDOWN = f"CASE (doc_id + ln // 2) % {len(KINDS)} {LINE} END"
KIND_SQL = " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in blocks.LINE_KINDS)
PATTERN = dict(blocks.LINE_KINDS)


@query(f"""WITH r AS (SELECT doc_id, i - 1 AS ln, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
l AS (SELECT doc_id, ln, regexp_replace({MARKDOWN}, '[\\s]+$', '') AS line FROM r), k AS (SELECT *, CASE WHEN line = '' THEN 'blank' {KIND_SQL} ELSE 'plain' END AS kind FROM l),
b AS (SELECT *, lag(kind, 1, 'blank') OVER (PARTITION BY doc_id ORDER BY ln) AS before FROM k), s AS (SELECT *, CASE kind WHEN 'blank' THEN 0 WHEN 'table' THEN (before <> 'table')::INT WHEN 'plain' THEN (before IN ('blank', 'heading', 'table'))::INT ELSE 1 END AS st FROM b),
n AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS block FROM s),
c AS (SELECT doc_id, block, ln, kind, CASE kind WHEN 'heading' THEN length(regexp_extract(line, '{PATTERN["heading"]}', 1))::VARCHAR WHEN 'footnote' THEN regexp_extract(line, '{PATTERN["footnote"]}', 1) WHEN 'number' THEN regexp_extract(line, '{PATTERN["number"]}', 1) END AS marker,
CASE kind WHEN 'table' THEN array_to_string(list_transform(string_split(regexp_extract(line, '{PATTERN["table"]}', 1), '|'), lambda x: trim(x)), chr(9)) WHEN 'heading' THEN trim(regexp_extract(line, '{PATTERN["heading"]}', 2)) WHEN 'footnote' THEN trim(regexp_extract(line, '{PATTERN["footnote"]}', 2)) WHEN 'bullet' THEN trim(regexp_extract(line, '{PATTERN["bullet"]}', 1)) WHEN 'number' THEN trim(regexp_extract(line, '{PATTERN["number"]}', 2)) ELSE trim(line) END AS said FROM n WHERE kind <> 'blank')
SELECT doc_id, CAST(block AS BIGINT) AS block, replace(arg_min(kind, ln), 'plain', 'paragraph') AS kind, min_by(struct_pack(m := marker), ln).m AS marker, md5(CASE WHEN arg_min(kind, ln) = 'table' THEN string_agg(said, chr(10) ORDER BY ln) ELSE trim(string_agg(said, ' ' ORDER BY ln)) END) AS content FROM c GROUP BY 1, 2""")
def markdown_blocks(s, d):
    r = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    lines = r.selectExpr("doc_id", "ln", MARKDOWN.replace("ln // 2", "ln div 2") + " AS line")
    docs = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return blocks.blocks(docs, "doc_id", "text").withColumn("content", F.md5("content"))


# A conversation's first turn as a paragraph with three words; its issues name one, two that lie together, and none of them.
@query("""WITH p AS (SELECT conv_id AS id, 'w' || conv_id || ' alpha beta gamma' AS target FROM conversations WHERE turn = 0), k AS (SELECT *, id % 4 AS k FROM p)
SELECT id AS paragraph_id, CASE k WHEN 0 THEN 'w' || id || ' ALPHA beta GAMMA' WHEN 1 THEN 'w' || id || ' x gamma' WHEN 2 THEN 'w' || id || ' alpha beta gamma' ELSE 'w' || id || ' ALPHA beta gamma' END AS target,
CASE k WHEN 0 THEN 'accepted,open,accepted,open' WHEN 1 THEN 'outdated,accepted,open,open' WHEN 2 THEN 'open,open,open,open' ELSE 'accepted,open,open,open' END AS statuses,
CASE k WHEN 0 THEN '1:accepted,3:accepted' WHEN 1 THEN '2:accepted,1:not_open' WHEN 2 THEN '4:fragment_not_found,9:not_found' ELSE '1:accepted,1:not_open' END AS outcomes FROM k""")
def accepted_edits(s, d):
    p = table(s, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("paragraph_id"), F.concat(F.lit("w"), "conv_id", F.lit(" alpha beta gamma")).alias("target"))
    fragments = ((1, "alpha", "ALPHA"), (2, "alpha beta", "x"), (3, "gamma", "GAMMA"), (4, "delta", "y"))
    at = lambda name: F.element_at(F.array(*[F.lit(f[name]) for f in fragments]), F.col("issue_id").cast("int"))
    k = F.col("paragraph_id") % 4
    frag = F.when((F.col("issue_id") == 2) & (k != 1), "beta").when((F.col("issue_id") == 4) & (k != 2), "gam").otherwise(at(1))
    issues = p.select("paragraph_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("issue_id")).select("paragraph_id", "issue_id", F.when((F.col("issue_id") == 4) & (k != 2), "beta").otherwise(frag).alias("fragment"), at(2).alias("suggestion"), F.lit("open").alias("status"))
    turns = F.when(k == 0, F.array(F.lit(1), F.lit(3))).when(k == 1, F.array(F.lit(2), F.lit(1))).when(k == 2, F.array(F.lit(4), F.lit(9))).otherwise(F.array(F.lit(1), F.lit(1)))
    asked = p.select("paragraph_id", F.posexplode(turns).alias("place", "issue_id"))
    out = edits.applied(p, issues.withColumn("fragment", F.when((k == 1) & (F.col("issue_id") == 4), "gamma").otherwise(F.col("fragment"))), asked)
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return out.select("paragraph_id", "target", joined("issues", lambda i: i["status"]).alias("statuses"), joined("log", lambda x: F.concat(x["issue_id"].cast("string"), F.lit(":"), x["outcome"])).alias("outcomes"))


REGISTRY = """m AS (SELECT DISTINCT 'b' || p_size AS name, 'p' || p_size AS params FROM part), w AS (SELECT DISTINCT 'b' || (p_size + 20) AS name, 'new' AS params FROM part),
r AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'criterion' ELSE 'translator_config' END AS "table", p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN 'b' || (p_size + 20) END AS model FROM part)"""


@query(f"""WITH {REGISTRY}, v AS (SELECT *, (model IS DISTINCT FROM 'b30' AND ("table" = 'criterion' OR model IS NOT NULL)) AS moves FROM r), k AS (SELECT model AS name FROM v WHERE NOT moves AND model IS NOT NULL UNION SELECT 'b30' FROM v WHERE moves)
SELECT 1 AS step, 'model' AS "table", name AS id, NULL AS old, params AS "new" FROM w WHERE name NOT IN (SELECT name FROM m) UNION ALL SELECT 2, "table", id::VARCHAR, model, 'b30' FROM v WHERE moves
UNION ALL SELECT 3, 'model', name, params, NULL FROM m WHERE name NOT IN (SELECT name FROM w) AND name NOT IN (SELECT name FROM k)""")
def registry_migration(s, d):
    return migration.registry_changes(*_registry(s, d), "b30")


def _registry(s, d):
    p = table(s, d, "part")
    models = p.selectExpr("'b' || p_size AS name", "'p' || p_size AS params").distinct()
    wanted = p.selectExpr("'b' || (p_size + 20) AS name", "'new' AS params").distinct()
    refs = p.selectExpr("CASE p_partkey % 3 WHEN 0 THEN 'criterion' ELSE 'translator_config' END AS `table`", "p_partkey AS id", "CASE WHEN p_partkey % 5 <> 0 THEN 'b' || (p_size + 20) END AS model")
    return models, wanted, refs


CRITERIA_SQL = "c AS (SELECT DISTINCT event_type AS crit, CASE WHEN event_type < 'f' THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM events)"


@query(f"""WITH {CRITERIA_SQL}, e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT 1 AS step, CASE WHEN k % 3 = 0 THEN 'issue' ELSE 'score' END AS "table", event_id::VARCHAR AS id, CASE WHEN k % 3 = 0 THEN 'open' ELSE 'live' END AS old, 'archived' AS "new" FROM e WHERE event_type IN ('view', 'error') AND k % 10 <> 3
UNION ALL SELECT 2, 'criterion', crit, weight::VARCHAR, NULL FROM c WHERE crit IN ('view', 'error') UNION ALL SELECT 3, 'weight', crit, weight::VARCHAR, '4.0' FROM c WHERE crit IN ('click') AND weight = 1.0""")
def criteria_reduction(s, d):
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    crit = e.select(F.col("event_type").alias("crit"), F.when(F.col("event_type") < "f", 1.0).otherwise(2.0).alias("weight")).distinct()
    state = lambda live: F.when(F.col("k") % 10 == 3, "archived").otherwise(live)
    scores = e.where("k % 3 <> 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("crit"), state("live").alias("kind"))
    issues = e.where("k % 3 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("crit"), state("open").alias("status"))
    return migration.criteria_changes(crit, scores, issues, ["view", "error", "absent"], {"click": (1.0, 4.0), "signup": (1.0, 3.0), "view": (2.0, 9.0)})


@query("""WITH l AS (SELECT conv_id, '| ' || (turn + 1) || ' | ' || replace(replace(text, '|', '\\|'), chr(10), '<br>') || ' | ' || role || '\\|<br>' || ' |' || chr(10) AS line, turn FROM conversations)
SELECT conv_id AS doc_id, md5('# Talk ' || conv_id || chr(10) || chr(10) || '| ¶ | Source (ru) | Translation (en) |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, '' ORDER BY turn)) AS markdown FROM l GROUP BY conv_id""")
def markdown_export(s, d):
    c = table(s, d, "conversations")
    docs = c.select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.concat(F.lit("Talk "), "doc_id").alias("title"), F.lit("ru").alias("source_lang"), F.lit("en").alias("target_lang"))
    rows = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("place"), F.col("text").alias("source"), F.concat("role", F.lit("|\n")).alias("target"))
    return reports.markdown(docs, rows).withColumn("markdown", F.md5("markdown"))

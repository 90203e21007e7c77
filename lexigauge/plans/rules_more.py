"""Queries of text rules, whole results and assembled documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigauge.functions import names
from lexigauge.operators import harness, scores
from lexigauge.plans.catalog import SCORE, WORDS
from lexigauge.plans.evaluation_more import WILSON
from lexigauge.plans.registry import query
from lexigauge.sources import tables
from lexigauge.sources.tables import table

KNOWN = "CASE lower({0}) " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in names.LANGUAGES.items()) + " END"


@query(f"""SELECT p_partkey, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name || '  ' || p_brand, ' ') IF w <> ''], ' ') AS titled, coalesce({KNOWN.format("code")}, code) AS lang, coalesce({KNOWN.format("code")}, CASE WHEN regexp_matches(code, '^[A-Za-z]{{2,3}}(-[A-Za-z0-9]+)*$') THEN code ELSE upper(code[1]) || code[2:] END) AS label,
p_name || ' x ' || p_brand AS one_line FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'RU' WHEN 1 THEN 'pt-BR' WHEN 2 THEN 'old slavic' WHEN 3 THEN 'en' ELSE 'xx' END AS code FROM part)""")
def display_names(s, d):
    k = F.col("p_partkey") % 5
    code = F.when(k == 0, "RU").when(k == 1, "pt-BR").when(k == 2, "old slavic").when(k == 3, "en").otherwise("xx")
    raw = F.concat(F.lit(" \x07"), "p_name", F.lit("\n x\t\x1f "), "p_brand", F.lit(" "))
    return table(s, d, "part").select("p_partkey", names.title_case(F.concat_ws("  ", "p_name", "p_brand")).alias("titled"), names.language(code).alias("lang"), names.language_label(code).alias("label"), names.on_one_line(raw).alias("one_line"))


@query("""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(CASE WHEN p_partkey % 9 = 0 THEN '!!' ELSE p_name || ' / ' || p_brand END), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'document') AS slug, replace(p_brand || '/a:' || p_size, '/', '__').replace(':', '_') AS stored, regexp_replace(p_name || ' (' || p_size || ')é.x', '[^\\w\\-.é]', '_', 'g') AS filed,
replace('m/' || p_brand || '.5', '/', '--') || '--provider-' || p_size AS run, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE '"' || p_name END AS reply, p_name AS plain FROM part""")
def clean_names(s, d):
    k = F.col("p_partkey") % 3
    size = F.col("p_size").cast("string")
    title = F.when(F.col("p_partkey") % 9 == 0, "!!").otherwise(F.concat_ws(" / ", "p_name", "p_brand"))
    reply = F.when(k == 0, F.concat(F.lit(" ```text\n\"'"), "p_name", F.lit("\n```  "))).when(k == 1, F.concat(F.lit("“ "), "p_brand", F.lit(" ”\n"))).otherwise(F.concat(F.lit('"'), "p_name"))
    reply = names.without_wrapping(reply)
    return table(s, d, "part").select(
        "p_partkey", names.document_slug(title).alias("slug"), names.storage_name(F.concat("p_brand", F.lit("/a:"), size)).alias("stored"), names.file_name(F.concat("p_name", F.lit(" ("), size, F.lit(")é.x"))).alias("filed"),
        names.run_name(F.concat(F.lit("m/"), "p_brand", F.lit(".5")), F.concat(F.lit("provider-"), size)).alias("run"), F.when(k == 0, F.substr(reply, F.lit(3))).otherwise(reply).alias("reply"), names.without_label(F.concat(F.lit(" Translated text : "), "p_name")).alias("plain"),
    )


@query("""WITH t AS (SELECT doc_id, replace(replace(text, chr(10), CASE doc_id % 3 WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) || ' ' || chr(10) ELSE chr(10) END), '. ', '.' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '# head' ELSE '<picture>' END || chr(10) || chr(10)) AS t FROM documents),
b AS (SELECT doc_id, [x FOR x IN [trim(y, ' ' || chr(10) || chr(9) || chr(13)) FOR y IN regexp_split_to_array(t, '\\n{2,}')] IF x <> '' AND x[1] <> '#' AND x <> '<picture>'] AS c, [x FOR x IN [trim(y, ' ' || chr(10) || chr(9) || chr(13)) FOR y IN regexp_split_to_array(t, '\\n\\s*\\n')] IF x <> ''] AS u FROM t)
SELECT doc_id, len(c) AS n_chapter, md5(array_to_string(c, '|')) AS chapter, len(u) AS n_upload, md5(array_to_string(u, '|')) AS upload FROM b""")
def paragraph_blocks(s, d):
    k = F.col("doc_id") % 3
    sep = F.when(k == 0, "\n\n").when(k == 1, "\n \n").otherwise("\n")
    mark = F.when(F.col("doc_id") % 2 == 0, "# head").otherwise("![a b](c.png)")
    raw = F.replace(F.replace("text", F.lit("\n"), sep), F.lit(". "), F.concat(F.lit(".\n\n"), mark, F.lit("\n\n")))
    t = table(s, d, "documents").select("doc_id", names.pictures_marked(raw).alias("t"))
    chapter, upload = names.chapter_blocks(F.col("t")), names.blank_line_blocks(F.col("t"))
    return t.select("doc_id", F.size(chapter).cast("long").alias("n_chapter"), F.md5(F.array_join(chapter, "|")).alias("chapter"), F.size(upload).cast("long").alias("n_upload"), F.md5(F.array_join(upload, "|")).alias("upload"))


@query("""WITH l AS (SELECT doc_id, i - 1 AS idx, CASE WHEN (doc_id + i) % 7 = 0 THEN ' Picture text ' WHEN (doc_id + i) % 7 = 1 THEN upper(line) ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
SELECT doc_id, count(*) AS n_body, sum(idx + 1) AS place_sum FROM l WHERE trim(line) <> '' AND trim(line) <> 'Picture text' AND NOT (upper(trim(line)) = trim(line) AND regexp_matches(line, '\\p{L}')) GROUP BY doc_id""")
def body_places(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    k = (F.col("doc_id") + F.col("idx") + 1) % 7
    line = F.when(k == 0, " Picture text ").when(k == 1, F.upper("line")).otherwise(F.col("line"))
    return lines.where(names.is_body(line)).groupBy("doc_id").agg(F.count("*").alias("n_body"), F.sum(F.col("idx") + 1).cast("long").alias("place_sum"))


SURVIVAL = """x AS (SELECT title, qid, unnest(range(0, span + 1)) AS o, idx, span FROM gold), gb AS (SELECT DISTINCT title, qid, idx, span, (idx + o) // 16 AS b FROM x), y AS (SELECT title, idx, span, qid AS got, cands, unnest(range(0, span + 1)) AS o FROM last), pb AS (SELECT DISTINCT title, idx, span, got, cands, (idx + o) // 16 AS b FROM y),
h AS (SELECT g.title, g.qid, bool_or(list_contains(p.cands, g.qid)) AS found, bool_or(p.got = g.qid) AS direct FROM gb g JOIN pb p ON g.title = p.title AND g.b = p.b AND g.idx < p.idx + p.span AND p.idx < g.idx + g.span GROUP BY ALL),
e AS (SELECT count(*) AS n, count(h.qid) AS rec, count(*) FILTER (found) AS found, count(*) FILTER (found AND direct) AS ok, count(*) FILTER (direct) AS direct, count(*) FILTER (direct AND NOT found) AS miss FROM (SELECT DISTINCT title, qid FROM gold) g LEFT JOIN h USING (title, qid)),
l AS (SELECT count(*) AS linked, count(g.qid) AS linked_real FROM (SELECT DISTINCT title, qid FROM pred) p LEFT JOIN (SELECT DISTINCT title, qid FROM gold) g USING (title, qid)),
m AS (SELECT unnest([('R_NER', rec, n), ('R_search', found, rec), ('A_disamb', ok, found), ('R', ok, n), ('R_direct', direct, n), ('P', linked_real, linked), ('miss', miss, n)]) AS c FROM e, l), c AS (SELECT c[1] AS metric, c[2] AS matched, c[3] AS total, c[2] / c[3] AS p, c[3] AS n FROM m)"""
LAST = "last AS (SELECT title, idx, span, arg_max(qid, id) AS qid, arg_max(cands, id) AS cands FROM pred GROUP BY ALL)"


@query(f"WITH {WORDS}, {LAST}, {SURVIVAL} SELECT metric, matched, total, round(p, 4) AS value, {WILSON} FROM c")
def survival_rates(s, d):
    return harness.survival_rates(tables.mentions(s, d, "gold"), tables.mentions(s, d, "pred"))


RUNS = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), r AS (SELECT event_type, value, ['green', 'yellow', 'red'][1 + k % 3] AS gold_difficulty, ['green', 'yellow', 'red'][1 + (k // 3) % 3] AS pred_difficulty, 'Q' || (k % 5) AS gold_qid, CASE WHEN k % 4 > 0 THEN 'Q' || (k % 7) END AS pred_qid,
['green', 'yellow', 'red'][1 + k % 2] AS gold_pair, CASE WHEN k % 5 > 0 THEN ['green', 'yellow', 'red'][1 + k % 3] END AS pred_pair, CASE WHEN k % 3 = 0 THEN 'Use ' || (k % 4) END AS gold_recommended, ' use ' || (k % 8) AS pred_recommended, ['exact_label', 'llm_disambiguation', 'judge_rejected', 'no_candidates'][1 + k % 4] AS resolved_by FROM e)"""


def _runs(s, d):
    k = F.col("k")
    colour = lambda i: F.element_at(F.array(F.lit("green"), F.lit("yellow"), F.lit("red")), (i + 1).cast("int"))
    way = F.element_at(F.array(F.lit("exact_label"), F.lit("llm_disambiguation"), F.lit("judge_rejected"), F.lit("no_candidates")), (k % 4 + 1).cast("int"))
    e = table(s, d, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.select(
        "event_type", "value", colour(k % 3).alias("gold_difficulty"), colour(F.floor(k / 3) % 3).alias("pred_difficulty"), F.concat(F.lit("Q"), k % 5).alias("gold_qid"), F.when(k % 4 > 0, F.concat(F.lit("Q"), k % 7)).alias("pred_qid"),
        colour(k % 2).alias("gold_pair"), F.when(k % 5 > 0, colour(k % 3)).alias("pred_pair"), F.when(k % 3 == 0, F.concat(F.lit("Use "), k % 4)).alias("gold_recommended"), F.concat(F.lit(" use "), k % 8).alias("pred_recommended"), way.alias("resolved_by"),
    )


F1 = "CASE WHEN count(*) FILTER (t = '{0}' OR p = '{0}') > 0 THEN 2.0 * count(*) FILTER (t = '{0}' AND p = '{0}') / (count(*) FILTER (t = '{0}') + count(*) FILTER (p = '{0}')) ELSE 0 END"
MACRO = "(" + " + ".join(f"CASE WHEN count(*) FILTER (t = '{c}') > 0 THEN {F1.format(c)} ELSE 0 END" for c in ("green", "yellow", "red")) + ") / greatest(1, " + " + ".join(f"max((t = '{c}')::INT)" for c in ("green", "yellow", "red")) + ")"


@query(f"""WITH {RUNS}, n AS (SELECT *, gold_difficulty = 'red' AS red, gold_difficulty <> 'red' AND coalesce(pred_pair = gold_pair, false) AND gold_recommended IS NOT NULL AS scope FROM r), v AS (SELECT event_type, gold_pair AS t, coalesce(pred_pair, 'red') AS p FROM n WHERE NOT red), f AS (SELECT event_type, round({MACRO}, 4) AS verdict_f1 FROM v GROUP BY 1)
SELECT event_type, count(*) FILTER (NOT red) AS n_non_red, any_value(verdict_f1) AS verdict_f1, round(count(*) FILTER (red AND pred_pair IS NULL) / count(*) FILTER (red), 4) AS null_accuracy, round(count(*) FILTER (scope AND lower(trim(pred_recommended)) = lower(trim(gold_recommended))) / count(*) FILTER (scope), 4) AS recommended_accuracy, count(*) FILTER (scope) AS recommended_n FROM n JOIN f USING (event_type) GROUP BY 1""")
def pairing_scores(s, d):
    return harness.pairing_scores(_runs(s, d), "event_type")


@query(f"""WITH {RUNS}, g AS (SELECT event_type, count(*) AS rows, count(*) FILTER (gold_difficulty <> 'red') AS n, count(*) FILTER (gold_difficulty <> 'red' AND pred_qid = gold_qid) AS correct, count(*) FILTER (gold_difficulty = 'red' AND pred_difficulty = 'red') AS red_hit, count(*) FILTER (gold_difficulty = 'red') AS red_total,
round(count(*) FILTER (resolved_by IN ('llm_disambiguation', 'judge_rejected')) / count(*), 4) AS escalation_rate, {", ".join(f"count(*) FILTER (resolved_by = '{w}') AS n_{w}" for w in harness.WAYS)}, count(*) FILTER (gold_difficulty <> 'red' AND pred_qid = gold_qid) / count(*) FILTER (gold_difficulty <> 'red') AS p FROM r GROUP BY 1)
SELECT event_type, rows AS n, n AS n_groundable, correct, round(p, 4) AS accuracy, {WILSON}, red_hit, red_total, escalation_rate, {", ".join(f"n_{w}" for w in harness.WAYS)} FROM g""")
def grounding_metrics(s, d):
    return harness.grounding_metrics(_runs(s, d), "event_type")


RANKED_RUNS = f"""WITH {RUNS}, w AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r WHERE value IS NOT NULL),
l AS (SELECT event_type, round(max(value) FILTER (i = least(n, CAST(floor(n * 50 / 100) AS BIGINT) + 1)), 1) AS p50, round(max(value) FILTER (i = least(n, CAST(floor(n * 95 / 100) AS BIGINT) + 1)), 1) AS p95, round(max(value), 1) AS max, max(n) AS n FROM w GROUP BY 1)"""


@query(RANKED_RUNS + " SELECT * FROM l")
def latency_summary(s, d):
    return harness.latency(table(s, d, "events"), "event_type", "value")


@query(RANKED_RUNS + f""", v AS (SELECT event_type, gold_difficulty AS t, pred_difficulty AS p FROM r), f AS (SELECT event_type, round({MACRO}, 4) AS f1 FROM v GROUP BY 1), a AS (SELECT event_type, round(avg((gold_difficulty = pred_difficulty)::INT), 1) AS accuracy, round(count(*) / 10, 0) AS calls FROM r GROUP BY 1)
SELECT event_type, accuracy, f1, calls, p50, row_number() OVER (ORDER BY accuracy DESC, f1 DESC, calls, p50, event_type) AS place, row_number() OVER (ORDER BY accuracy DESC, f1 DESC, calls, p50, event_type) = 1 AS winner FROM a JOIN f USING (event_type) JOIN l USING (event_type)""")
def strategy_ranking(s, d):
    r = _runs(s, d)
    a = r.groupBy("event_type").agg(F.round(F.avg((F.col("gold_difficulty") == F.col("pred_difficulty")).cast("int")), 1).alias("accuracy"), harness.macro_f1("gold_difficulty", "pred_difficulty").alias("f1"), F.round(F.count("*") / 10, 0).alias("calls"))
    return harness.ranking(a.join(harness.latency(r, "event_type", "value").select("event_type", "p50"), "event_type"), "event_type")


@query("""WITH u AS (SELECT conv_id % 7 AS k, conv_id AS doc_id, turn AS place, CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN ' ' ELSE text END AS s, CASE WHEN conv_id % 7 = 4 THEN '' WHEN conv_id % 7 = 5 THEN repeat(text, 9) ELSE role END AS t, conv_id % 2 = 0 AS translate FROM conversations WHERE conv_id % 7 <> 6 OR turn < 0),
d AS (SELECT DISTINCT conv_id AS doc_id, conv_id % 7 AS k, conv_id % 2 = 0 AS translate FROM conversations), f AS (SELECT doc_id, any_value(translate) AS translate, min(place) FILTER (trim(s) = '' OR (NOT translate AND trim(t) = '')) AS e, min(place) FILTER (length(s) > 4000 OR (NOT translate AND length(t) > 4000)) AS l, bool_or(trim(t) <> '') AS filled FROM u GROUP BY 1)
SELECT doc_id, CASE WHEN k = 0 THEN 'title_required' WHEN k = 1 THEN 'lang_required' WHEN k = 2 THEN 'same_language' WHEN f.doc_id IS NULL THEN 'empty_paragraphs' WHEN e IS NOT NULL AND (l IS NULL OR e <= l) THEN 'empty_cell:' || e WHEN l IS NOT NULL THEN 'paragraph_too_long:' || l WHEN f.translate AND filled THEN 'mixed_targets' END AS verdict FROM d LEFT JOIN f USING (doc_id)""")
def upload_validation(s, d):
    c = table(s, d, "conversations").withColumn("k", F.col("conv_id") % 7)
    docs = c.select(F.col("conv_id").alias("doc_id"), "k").distinct()
    docs = docs.select("doc_id", F.when(F.col("k") == 0, " ").otherwise("Title").alias("title"), F.when(F.col("k") == 1, "\x07 ").otherwise("ru").alias("source_lang"), F.when(F.col("k") == 2, "RU\n").otherwise("en").alias("target_lang"), (F.col("doc_id") % 2 == 0).alias("translate"))
    source = F.when((F.col("k") == 3) & (F.col("turn") == 1), " ").otherwise(F.col("text"))
    target = F.when(F.col("k") == 4, "").when(F.col("k") == 5, F.repeat("text", F.lit(9))).otherwise(F.col("role"))
    pairs = c.where("k <> 6").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("place"), source.alias("source"), target.alias("target"))
    return harness.upload_verdicts(docs, pairs)


@query(f"WITH {SCORE}, n AS (SELECT *, row_number() OVER (PARTITION BY para ORDER BY ts DESC, id DESC) AS r FROM score WHERE kind IN ('seed', 'live')), c AS (SELECT para, crit, value, row_number() OVER (PARTITION BY para, crit ORDER BY (kind = 'cache'), ts DESC, id DESC) AS r FROM score WHERE kind IN ('live', 'cache')) SELECT para, c.crit, c.value, n.value AS newest FROM c JOIN n USING (para) WHERE c.r = 1 AND n.r = 1")
def fresh_or_cached(s, d):
    """Live values before cached ones per criterion, and the newest row of the paragraph."""
    sc = tables.scores(s, d)
    newest = scores.newest(scores.live(sc), ["para"]).select("para", F.col("value").alias("newest"))
    w = Window.partitionBy("para", "crit").orderBy(F.col("kind") == "cache", F.desc("ts"), F.desc("id"))
    best = sc.where("kind IN ('live', 'cache')").withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("para", "crit", "value").join(newest, "para")


@query(f"""WITH {SCORE}, c AS (SELECT para, list({{'id': id, 'crit': crit, 'kind': kind}} ORDER BY ts, id) AS s, count(*) AS n FROM score GROUP BY para), p AS (SELECT para % 20 AS doc, para, n, md5(array_to_string([x.id || ':' || x.crit || ':' || x.kind FOR x IN s], ',')) AS h FROM c)
SELECT doc, count(*) AS n_paragraphs, sum(n)::BIGINT AS n_scores, md5(string_agg(para || '=' || h, ';' ORDER BY para)) AS content FROM p GROUP BY doc""")
def nested_documents(s, d):
    """Documents with their paragraphs in order, and in these their scores in order."""
    sc = tables.scores(s, d)
    per = sc.groupBy("para").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "crit", "kind"))).alias("scores"))
    docs = per.groupBy((F.col("para") % 20).alias("doc")).agg(F.sort_array(F.collect_list(F.struct("para", "scores"))).alias("paragraphs"))
    line = lambda x: F.concat_ws(":", x["id"].cast("string"), x["crit"], x["kind"])
    told = F.transform("paragraphs", lambda p: F.concat(p["para"].cast("string"), F.lit("="), F.md5(F.array_join(F.transform(p["scores"], line), ","))))
    n = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda a, p: a + F.size(p["scores"]))
    return docs.select("doc", F.size("paragraphs").cast("long").alias("n_paragraphs"), n.alias("n_scores"), F.md5(F.array_join(told, ";")).alias("content"))




# Latin letters and what stands for them, so that rules for Cyrillic meet the driver's texts.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "абцдефгхийклмнопярстуввхузАБЦДЕФГХИЙКЛМНОПЯРСТУВВХУЗ"


@query()
def deterministic_terms(s, d):
    """Capitalised runs and listed words of turns with their places; no SQL for claims. Brute force in the tests."""
    from lexigauge.operators import extraction

    rows = table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), F.translate("text", LATIN, CYRILLIC).alias("text"))
    return extraction.deterministic(rows, "turn_id", [("тхе", "other"), ("анд", "place"), ("оф", None)])


@query()
def page_titles(s, d):
    """The different titles that a page's paragraphs link to; no SQL for parsing HTML."""
    from lexigauge.operators import anchors

    paragraphs = F.replace(F.regexp_replace("html", r"<(/?)li\b", "<$1p"), F.lit('href="/'), F.lit('href="./'))
    found = anchors.found(table(s, d, "pages").withColumn("html", paragraphs), "page_id", "html")
    return found.where("title IS NOT NULL").groupBy("page_id").agg(F.sort_array(F.collect_set("title")).alias("titles"))

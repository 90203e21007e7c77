"""Queries of evaluation beyond single scores: paired tests, nested tiers, slices, pooled precision, stitched tuples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigauge.operators import paired, stitching
from lexigauge.plans.catalog import SCORE, WORDS
from lexigauge.plans.registry import query
from lexigauge.sources import tables
from lexigauge.sources.tables import table

PAIRS = "d AS (SELECT para, crit, max(floor(value / 50)) FILTER (kind = 'seed') - max(floor(value / 50)) FILTER (kind = 'live') AS d FROM score GROUP BY ALL HAVING d IS NOT NULL)"
POISSON_SQL = " + ".join(f"(u >= {c})::INT" for c in paired.POISSON)


def _pairs(s, d):
    level = lambda k: F.max(F.when(F.col("kind") == k, F.floor(F.col("value") / 50)))
    return tables.scores(s, d).groupBy("para", "crit").agg((level("seed") - level("live")).alias("d")).where("d IS NOT NULL")


@query(f"""WITH {SCORE}, {PAIRS}, r AS (SELECT crit, d, (rank() OVER (PARTITION BY crit ORDER BY abs(d)) + (count(*) OVER (PARTITION BY crit, abs(d)) - 1) / 2) AS rk FROM d WHERE d <> 0),
t AS (SELECT crit, sum(c * c * c - c) AS ties FROM (SELECT crit, abs(d), count(*) AS c FROM d WHERE d <> 0 GROUP BY ALL) GROUP BY 1),
w AS (SELECT crit, count(*) AS n, sum(rk) FILTER (d > 0) AS w_plus, sum(rk) FILTER (d < 0) AS w_minus FROM r GROUP BY 1),
z AS (SELECT w.*, ties, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w JOIN t USING (crit)),
p AS (SELECT *, 1 / (1 + {paired.ERF_P} * abs(z) / sqrt(2)) AS t FROM z), q AS (SELECT *, ({paired.ERF[0]} * t + {paired.ERF[1]} * t ** 2 + {paired.ERF[2]} * t ** 3 + {paired.ERF[3]} * t ** 4 + {paired.ERF[4]} * t ** 5) * exp(-z * z / 2) AS p FROM p),
h AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, crit) + 1)) AS step FROM q)
SELECT crit, n, (SELECT count(*) FROM d WHERE d.crit = h.crit AND d.d = 0) AS n_zero, least(w_plus, w_minus) AS w, round(z, 6) AS z, round(p, 6) AS p, round(max(step) OVER (ORDER BY p, crit), 6) AS p_holm FROM h""")
def paired_signed_ranks(s, d):
    out = paired.holm(paired.signed_ranks(_pairs(s, d), ["crit"], "d"), [], order=["crit"])
    return out.select("crit", "n", "n_zero", "w", *[F.round(c, 6).alias(c) for c in ("z", "p", "p_holm")])


@query(f"""WITH {SCORE}, {PAIRS}, i AS (SELECT unnest(range(0, 10)) AS i), x AS (SELECT crit, d, i, j, CAST('0x' || substr(md5('1:' || para || ':' || i), 8 * j + 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM d, i, (SELECT unnest(range(0, 4)) AS j)),
m AS (SELECT crit, i * 4 + j AS r, sum(w * d) / sum(w) AS m FROM (SELECT *, {POISSON_SQL} AS w FROM x) GROUP BY ALL HAVING sum(w) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY crit ORDER BY m, r) AS k, count(*) OVER (PARTITION BY crit) AS n FROM m)
SELECT crit, round((SELECT avg(d) FROM d WHERE d.crit = k.crit), 6) AS mean, round(min(m) FILTER (k >= ceil(n * 5 / 200)), 6) AS low, round(min(m) FILTER (k >= ceil(n * 195 / 200)), 6) AS high FROM k GROUP BY crit""")
def paired_bootstrap(s, d):
    out = paired.bootstrap(_pairs(s, d), ["crit"], "para", "d", replicates=40)
    return out.select("crit", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


LEVEL = "CASE length(qid) % 4 WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 0 END"
WILSON = "round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 4) AS low, round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 4) AS high"


@query(f"""WITH {WORDS}, g AS (SELECT title, idx, qid, {LEVEL} AS level FROM gold), h AS (SELECT g.*, (title, idx, qid) IN (SELECT title, idx, qid FROM pred) AS hit FROM g),
t AS (SELECT tier, hit, unnest([('all', 'all'), ('stratum', (title % 3)::VARCHAR), ('length', length(qid)::VARCHAR)]) AS c FROM h, (SELECT unnest(range(0, 3)) AS tier) WHERE level = 0 OR level > tier),
n AS (SELECT tier, c[1] AS slice, c[2] AS value, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) / count(*) AS p FROM t GROUP BY ALL) SELECT tier, slice, value, n, hits, round(p, 4) AS recall, {WILSON}, n < 30 AS underpowered FROM n""")
def recall_tiers(s, d):
    gold = tables.mentions(s, d, "gold").withColumn("level", F.expr(LEVEL))
    said = tables.mentions(s, d, "pred").select("title", "idx", "qid").distinct().withColumn("hit", F.lit(True))
    return stitching.recall_tiers(gold.join(said, ["title", "idx", "qid"], "left"), "hit", "level", {"stratum": F.col("title") % 3, "length": F.length("qid")})


@query(f"WITH {WORDS}, p AS (SELECT DISTINCT title, qid FROM pred WHERE qid IS NOT NULL), g AS (SELECT DISTINCT title, qid FROM gold), n AS (SELECT count(*) AS n, count(g.qid) AS hits, count(g.qid) / count(*) AS p FROM p LEFT JOIN g USING (title, qid)) SELECT n, hits, round(p, 4) AS precision, {WILSON} FROM n")
def linked_precision(s, d):
    return stitching.linked_precision(tables.mentions(s, d, "gold"), tables.mentions(s, d, "pred"))


@query("""WITH t AS (SELECT conv_id, turn, string_split_regex(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\\s+') AS t, text FROM conversations), b AS (SELECT *, sum(len(t)) OVER (PARTITION BY conv_id ORDER BY turn) - len(t) AS base FROM t)
SELECT conv_id AS title, turn AS place, CAST(base + len(string_split_regex(substr(text, 1, length(text) // 2), '\\s+')) - 1 AS BIGINT) AS token FROM b""")
def stitched_tokens(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("title"), F.col("turn").alias("place"), "text")
    whole = c.groupBy("title").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    found = c.select("title", "place", F.floor(F.length("text") / 2).cast("int").alias("start"))
    return stitching.stitched(whole, c, found).select("title", "place", F.col("token").cast("long").alias("token"))

"""URL decisions that follow redirects: rules decide what they fit, aliases share a block.

Nodes are addresses without what doesn't change the page (scheme, default port, fragment, tracking parameters, a
slash at the end). Edges are canonical links and refresh redirects in the pages. In a connected component, pages
that no rule fits are blocked if some page is blocked and none is explicitly allowed; a rule on the page itself wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop, keep

#: (action, host and path prefix); a host stands for its subdomains too, and the longest rule that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
#: A tag as HTML reads it: a > in a quoted value doesn't end it. Possessive, so long tags need no stack.
TAG = r"(?is)<{}\b(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
ATTRIBUTE = r"(?is)[^\s=\"'<>/]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
DELAY = r"(?is)^[\s\d.]*+[;,]?\s*(?:url\s*=\s*)?[\"']?([^\"']*)"
# What the SQL twin reads: the first tag of each kind, quoted values, no relative targets.
CANONICAL = r"(?is)<link\b[^>]{0,2000}\brel\s*=\s*[\"']?canonical\b[^>]{0,2000}>"
HREF = r"(?is)\bhref\s*=\s*[\"']([^\"'>]*)[\"']"
REFRESH = r"(?is)<meta\b[^>]{0,2000}\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]{0,2000}>"
GOES_TO = r"(?is)\burl\s*=\s*'?([^\"'>]*)[\"']"
TRACKING = r"(?:^|&)(?:utm_[^&=]*|ref|fbclid|gclid)(?:=[^&]*)?"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def node(url: Column) -> Column:
    """The address that aliases share; null without a host."""
    h = F.regexp_replace(host(url), r":(?:80|443)$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_replace(_part(url, 3), r"^\?", ""), TRACKING, ""), "^&", "")
    return F.when(h != "", F.concat(h, F.regexp_replace(path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, ties to the longer host, then by alphabet; nulls if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), r[1])):
        on, slash, rest = text.partition("/")
        fits = ((h == on) | h.endswith(f".{on}")) & p.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return rule, action


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, quoted or not; null if it has none."""
    mine = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda x: x.rlike(rf"(?is)^{name}\s*="))
    return F.trim(F.regexp_replace(F.regexp_replace(F.get(mine, 0), r"(?s)^[^=]*=\s*", ""), r"(?s)^[\"']|[\"']$", ""))


def _targets(html: Column) -> Column:
    """Where all canonical links and refresh tags of a page go, as they are written."""
    every = lambda name: F.coalesce(F.regexp_extract_all(html, F.lit(TAG.format(name)), F.lit(0)), F.array().cast("array<string>"))
    links = F.filter(every("link"), lambda x: _attribute(x, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"))
    metas = F.filter(every("meta"), lambda x: F.lower(_attribute(x, "http-equiv")) == "refresh")
    to = F.concat(F.transform(links, lambda x: _attribute(x, "href")), F.transform(metas, lambda x: F.trim(F.regexp_extract(_attribute(x, "content"), DELAY, 1))))
    return F.filter(to, lambda x: x != "")


def _undotted(p: Column) -> Column:
    """A path with its . and .. steps taken."""
    none = F.array().cast("array<string>")
    up = lambda got: F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(1)))
    steps = F.aggregate(F.split(p, "/", -1), none, lambda got, x: F.when(x == "..", up(got)).when(x == ".", got).otherwise(F.concat(got, F.array(x))))
    end = F.when(p.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(p.rlike(r"/\.{1,2}(?:/|$)"), F.concat(F.array_join(steps, "/"), end)).otherwise(p)


def _absolute(to: Column, url: Column) -> Column:
    """A link made absolute against its page; null for what isn't a page."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.concat(F.lit("/"), F.regexp_replace(path(url), "^/", "")), r"(?s)^(.*/)", 1)
    full = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to))
    full = full.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (site == ""), F.lit(None)).when(to.startswith("/"), F.concat(site, to))
    full = full.when(to.startswith("?") | to.startswith("#"), F.concat(site, path(url), to)).otherwise(F.concat(site, folder, to))
    return F.concat(F.regexp_extract(full, r"(?s)^(.*?://[^/?#]*)", 1), _undotted(path(full)), F.regexp_extract(full, r"(?s)^.*?://[^?#]*(.*)$", 1))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, via (rule, alias or default).

    A null url, or one without ://, has neither host nor path, fits no rule and is allowed. Null html has no links.
    All canonical links and refresh tags of a page count, relative ones from the page's path.
    """
    u = F.col("url")
    p = pages.select(F.col("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    # one step after another, so no pattern is run over the page's html more than once
    p = p.select("page_id", "url", host(u).alias("host"), path(u).alias("path"), _targets(F.col("html")).alias("goes"))
    p = p.withColumn("goes", F.transform("goes", lambda x: _absolute(x, u)))
    p = p.withColumn("goes", F.transform(F.filter("goes", lambda x: x.isNotNull()), lambda x: F.struct(node(x).alias("node"), host(x).alias("host"), path(x).alias("path"))))
    # of every tag where it goes, and what a rule says there
    aim = F.transform("goes", lambda x: F.struct(x["node"].alias("node"), rule_of(x["host"], x["path"], rules)[1].alias("action")))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    seen = p.select("page_id", "host", "path", node(u).alias("node"), aim.alias("to"), rule.alias("rule"), action.alias("action"))
    seen = keep(seen.withColumn("to", F.filter("to", lambda x: x["node"].isNotNull())))
    edges = seen.where("node is not null and size(to) > 0").select(F.col("node").alias("a"), F.explode("to.node").alias("b")).where("a <> b")
    root = keep(components(edges))
    # a rule on where a link goes counts, be that a row of pages or not
    of = seen.select("node", "action").where("node is not null").union(seen.where("node is not null").select(F.explode("to").alias("x")).select("x.*"))
    fate = of.groupBy("node").agg(F.bool_or(F.col("action") == "block").alias("block"), F.bool_or(F.col("action") == "allow").alias("allow"))
    fate = fate.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "block", "allow")
    whole = fate.groupBy("root").agg(F.bool_or("block").alias("any_block"), F.bool_or("allow").alias("any_allow"))
    fate = keep(fate.join(whole, "root").select("node", (F.coalesce("any_block", F.lit(False)) & ~F.coalesce("any_allow", F.lit(False))).alias("blocked")))
    drop(root)
    blocked = F.coalesce("blocked", F.lit(False))
    out = seen.join(fate.where("blocked"), "node", "left")
    verdict = F.coalesce("action", F.when(blocked, "block").otherwise("allow"))
    via = F.when(F.col("action").isNotNull(), "rule").when(blocked, "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), via.alias("via"))


#: The same in SQL, with components as the least node reachable over links.
SQL = f"""
WITH RECURSIVE rules(action, rule) AS (VALUES {", ".join(f"('{a}', '{r}')" for a, r in RULES)}),
p AS (SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
links AS (
  SELECT row, url, trim(regexp_extract(regexp_extract(html, '{CANONICAL.replace("'", "''").replace("{0,2000}", "*")}', 0), '{HREF.replace("'", "''")}', 1)) AS goes FROM p
  UNION ALL
  SELECT row, url, trim(regexp_extract(regexp_extract(html, '{REFRESH.replace("'", "''").replace("{0,2000}", "*")}', 0), '{GOES_TO.replace("'", "''")}', 1)) FROM p),
urls AS (
  SELECT row, 0 AS kind, url FROM p
  UNION ALL
  SELECT row, 1, CASE WHEN contains(goes, '://') THEN goes WHEN starts_with(goes, '//') THEN 'http:' || goes
    WHEN starts_with(goes, '/') AND contains(url, '://') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || goes END FROM links),
parts AS (
  SELECT row, kind, translate(regexp_extract(url, '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '{PARTS}', 2) AS path,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '{PARTS}', 3), '^\\?', ''), '{TRACKING}', '', 'g'), '^&', '') AS query FROM urls WHERE url IS NOT NULL),
nodes AS (
  SELECT row, kind, host, path, CASE WHEN regexp_replace(host, ':(?:80|443)$', '') <> '' THEN
    regexp_replace(host, ':(?:80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS node FROM parts),
fit AS (
  SELECT n.row, n.kind, n.host, n.path, n.node, arg_max(r.rule, (length(r.rule), strpos(r.rule, '/'), r.rule)) AS rule, arg_max(r.action, (length(r.rule), strpos(r.rule, '/'), r.rule)) AS action
  FROM nodes n LEFT JOIN rules r ON (n.host = split_part(r.rule, '/', 1) OR ends_with(n.host, '.' || split_part(r.rule, '/', 1))) AND starts_with(n.path, substr(r.rule, strpos(r.rule, '/')))
  GROUP BY ALL),
edges AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM nodes a JOIN nodes b USING (row) WHERE a.kind = 0 AND b.kind = 1 AND a.node IS NOT NULL AND b.node IS NOT NULL),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
fate AS (
  SELECT coalesce(root, f.node) AS root, bool_or(action = 'block') AND NOT coalesce(bool_or(action = 'allow'), false) AS blocked
  FROM fit f LEFT JOIN roots USING (node) WHERE f.node IS NOT NULL GROUP BY ALL)
SELECT p.page_id, f.host, f.path, f.rule, coalesce(f.action, CASE WHEN fate.blocked THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN f.action IS NOT NULL THEN 'rule' WHEN fate.blocked THEN 'alias' ELSE 'default' END AS via
FROM fit f JOIN p USING (row) LEFT JOIN roots USING (node) LEFT JOIN fate ON fate.root = coalesce(roots.root, f.node) WHERE f.kind = 0
"""

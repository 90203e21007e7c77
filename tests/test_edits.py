"""Edits, blocks and migrations against plain code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexigauge.operators import blocks, edits, migration, stitching


def test_edits_one_after_another(spark):
    """Fragments of one word each, so that a splice is a replacement of the first place."""
    rng = random.Random(5)
    vocabulary = ["ab", "cd", "ef", "gh"]
    paras, issues, asked, want = [], [], [], {}
    for p in range(40):
        target = " ".join(rng.choice(vocabulary) for _ in range(4))
        own = {p * 10 + i: [rng.choice([*vocabulary, "", "zz"]), rng.choice(["QQ", "RR", "", " ", "consider this"]), rng.choice(["open", "open", "open", "dismissed"])] for i in range(4)}
        turns = [p * 10 + rng.randrange(5) for _ in range(3)]
        paras.append((p, target))
        issues += [(i, p, *x) for i, x in own.items()]
        asked += [(p, i, n) for n, i in enumerate(turns)]
        log = []
        for i in turns:
            if i not in own:
                log.append((i, "not_found", []))
                continue
            frag, new, state = own[i]
            why = "not_open" if state != "open" else "no_suggestion" if not new.strip() else "advice_suggestion" if "consider" in new else "fragment_not_found" if not frag or frag not in target else "accepted"
            gone = []
            if why == "accepted":
                target = target.replace(frag, new, 1)
                own[i][2] = "accepted"
                for j, x in own.items():
                    if x[2] == "open" and (not x[0] or x[0] not in target):
                        x[2] = "outdated"
                        gone.append(j)
            log.append((i, why, gone))
        want[p] = (target, [x[2] for x in own.values()], log)
    out = edits.applied(spark.createDataFrame(paras, "paragraph_id int, target string"), spark.createDataFrame(issues, "issue_id int, paragraph_id int, fragment string, suggestion string, status string"), spark.createDataFrame(asked, "paragraph_id int, issue_id int, place int"))
    got = {r["paragraph_id"]: (r["target"], [i["status"] for i in r["issues"]], [(x["issue_id"], x["outcome"], x["outdated"]) for x in r["log"]]) for r in out.collect()}
    assert got == want
    assert {x[1] for v in want.values() for x in v[2]} == {"not_found", "not_open", "no_suggestion", "advice_suggestion", "fragment_not_found", "accepted"}
    assert any(x[2] for v in want.values() for x in v[2])


def test_edits_without_issues(spark):
    out = edits.applied(spark.createDataFrame([(1, None)], "paragraph_id int, target string"), spark.createDataFrame([], "issue_id int, paragraph_id int, fragment string, suggestion string, status string"), spark.createDataFrame([(1, 5, 0), (2, 5, 0)], "paragraph_id int, issue_id int, place int"))
    (row,) = out.collect()
    assert (row["target"], row["issues"], [x["outcome"] for x in row["log"]]) == ("", [], ["not_found"])


def plain_blocks(text):
    """Blocks by a walk over the lines."""
    kinds = [(k, re.compile(p.replace(r"\s*$", r"\s*\Z"))) for k, p in blocks.LINE_KINDS]
    out, before = [], "blank"
    for raw in (text or "").splitlines():
        line = raw.rstrip()
        kind, m = next(((k, m) for k, p in kinds if (m := p.match(line))), ("blank" if not line else "plain", None))
        if kind == "table":
            row = "\t".join(c.strip() for c in m[1].split("|"))
            if before == "table":
                out[-1][2] += "\n" + row
            else:
                out.append(["table", None, row])
        elif kind == "plain":
            if before in ("blank", "heading", "table"):
                out.append(["paragraph", None, line.strip()])
            else:
                out[-1][2] = f"{out[-1][2]} {line.strip()}".strip()
        elif kind != "blank":
            mark = {"heading": lambda: str(len(m[1])), "footnote": lambda: m[1], "number": lambda: m[1], "bullet": lambda: None}[kind]()
            out.append([kind, mark, m[m.re.groups].strip()])
        before = kind
    return [tuple(x) for x in out]


def test_blocks(spark):
    rng = random.Random(6)
    lines = ["# One", "###### Six  ", "####### no", "", "   ", "- item", "-no", "  more of it  ", "12. twelve", "1.no", "| a | b |", "|--|--|", "|x|  ", "| open", "[^n-1]: note", "[^n1]:", "plain", "\tplain **b**", "é — ü"]
    texts = [(i, rng.choice(["\n", "\r\n"]).join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(120)] + [(500, None), (501, ""), (502, "a b\x0bc")]
    got = {}
    for r in blocks.blocks(spark.createDataFrame(texts, "id int, t string"), "id", "t").orderBy("id", "block").collect():
        got.setdefault(r["id"], []).append((r["kind"], r["marker"], r["content"]))
    assert got == {i: b for i, t in texts if (b := plain_blocks(t))}


def test_migration_twice_changes_nothing(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    models = frame([("a", "1"), ("b", "2"), ("old", "3"), ("held", "4")], "name string, params string")
    wanted = frame([("a", "x"), ("new", "y")], "name string, params string")
    refs = frame([("criterion", 1, None), ("criterion", 2, "old"), ("criterion", 3, "a"), ("config", 1, None), ("config", 2, "b")], "table string, id int, model string")
    first = migration.registry_changes(models, wanted, refs, "a")
    assert sorted(map(tuple, first.collect()), key=str) == sorted([(1, "model", "new", None, "y"), (2, "criterion", "1", None, "a"), (2, "criterion", "2", "old", "a"), (2, "config", "2", "b", "a"), (3, "model", "b", "2", None), (3, "model", "old", "3", None), (3, "model", "held", "4", None)], key=str)
    models, refs = migration.migrated(models, refs, first)
    assert {r["name"]: r["params"] for r in models.collect()} == {"a": "1", "new": "y"}
    assert {(r["table"], r["id"]): r["model"] for r in refs.collect()} == {("criterion", "1"): "a", ("criterion", "2"): "a", ("criterion", "3"): "a", ("config", "1"): None, ("config", "2"): "a"}
    assert migration.registry_changes(models, wanted, refs, "a").count() == 0
    kept = migration.registry_changes(frame([("z", "1")], "name string, params string"), wanted, frame([("config", 1, "z")], "table string, id int, model string"), "z").collect()
    assert [r["id"] for r in kept if r["step"] == 3] == []


def test_criteria_once(spark):
    crit = spark.createDataFrame([("acc", 1.0), ("cult", 2.0), ("style", 9.0)], "crit string, weight double")
    scores = spark.createDataFrame([(1, "cult", "live"), (2, "cult", "archived"), (3, "acc", "live")], "id int, crit string, kind string")
    issues = spark.createDataFrame([(1, "cult", "open"), (2, "gone", "open")], "id int, crit string, status string")
    run = lambda c: sorted(tuple(r) for r in migration.criteria_changes(c, scores, issues, ["cult", "gone"], {"acc": (1.0, 4.0), "style": (2.0, 3.0)}).collect())
    assert run(crit) == [(1, "issue", "1", "open", "archived"), (1, "score", "1", "live", "archived"), (2, "criterion", "cult", "2.0", None), (3, "weight", "acc", "1.0", "4.0")]
    assert run(crit.where("crit <> 'cult'").withColumn("weight", F.lit(4.0))) == []


def test_stitching(spark):
    articles = spark.createDataFrame([("A", "one two\n\n three  four"), ("B", "x y"), ("C", None)], "title string, text string")
    paras = spark.createDataFrame([("A", 0, "one two"), ("A", 1, " three four"), ("B", 0, "x"), ("B", 1, "z")], "title string, place int, text string")
    assert {tuple(r) for r in stitching.rebuilt(articles, paras).collect()} == {("A", True), ("B", False), ("C", True)}
    m = spark.createDataFrame([("A", 0, 0, "one"), ("A", 0, 4, "two"), ("A", 1, 1, "three"), ("A", 1, 7, "four")], "title string, place int, start int, surface string")
    assert {r["surface"]: r["token"] for r in stitching.stitched(articles, paras, m).collect()} == {"one": 0, "two": 1, "three": 2, "four": 3}
    with pytest.raises(Exception, match="rebuild"):
        stitching.stitched(articles, paras, m.limit(1).withColumn("title", F.lit("B"))).collect()


def test_tiers_are_nested(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, True, False]), rng.choice([None, 0, 1, 2]), rng.choice(["x", None])) for _ in range(300)]
    got = {(r["tier"], r["slice"], r["value"]): (r["n"], r["hits"]) for r in stitching.recall_tiers(spark.createDataFrame(rows, "hit boolean, level int, s string"), "hit", "level", {"s": F.col("s")}).collect()}
    for tier in range(3):
        kept = [r for r in rows if not r[1] or r[1] > tier]
        assert got[tier, "all", "all"] == (len(kept), sum(bool(r[0]) for r in kept))
        for s in ("x", None):
            assert got[tier, "s", s or "none"] == (sum(r[2] == s for r in kept), sum(bool(r[0]) for r in kept if r[2] == s))
    assert got[0, "all", "all"][0] >= got[1, "all", "all"][0] >= got[2, "all", "all"][0]

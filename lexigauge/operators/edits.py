"""Accepted edits of paragraphs, one after another: the text, the status of every issue, a revision an edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.functions import forms
from lexigauge.functions.text import is_advice

ISSUES = "array<struct<issue_id:long,fragment:string,suggestion:string,status:string>>"
STATE = f"struct<target:string,issues:{ISSUES},log:array<struct<place:long,issue_id:long,outcome:string,target:string,outdated:array<long>>>>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def _let(value: Column, use) -> Column:
    """use(value), the value being worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _applied(state: Column, edit: Column) -> Column:
    """The state after one edit; refused ones only leave their reason in the log."""

    def with_issue(issue):
        return _let(forms.spliced(state["target"], issue["fragment"], issue["suggestion"]), lambda target: with_target(issue, target))

    def with_target(issue, target):
        outcome = (
            F.when(issue["issue_id"].isNull(), "not_found")
            .when(issue["status"] != "open", "not_open")
            .when(_strip(issue["suggestion"]) == "", "no_suggestion")
            .when(is_advice(issue["suggestion"]), "advice_suggestion")
            .when(target.isNull(), "fragment_not_found")
            .otherwise("accepted")
        )
        return _let(outcome, lambda said: with_outcome(target, said))

    def with_outcome(target, outcome):
        def status(i):
            mine = i["issue_id"] == edit["issue_id"]
            gone = (F.coalesce(i["fragment"], F.lit("")) == "") | forms.spliced(target, i["fragment"], i["fragment"]).isNull()
            return F.when(outcome != "accepted", i["status"]).when(mine, "accepted").when((i["status"] == "open") & gone, "outdated").otherwise(i["status"])

        marked = F.transform(state["issues"], lambda i: F.struct(i["issue_id"].alias("issue_id"), i["fragment"].alias("fragment"), i["suggestion"].alias("suggestion"), status(i).alias("status")))
        return _let(marked, lambda issues: with_issues(target, outcome, issues))

    def with_issues(target, outcome, issues):
        new = F.filter(F.zip_with(state["issues"], issues, lambda a, b: F.when((a["status"] != b["status"]) & (b["status"] == "outdated"), a["issue_id"])), lambda x: x.isNotNull())
        done = outcome == "accepted"
        entry = F.struct(edit["place"].alias("place"), edit["issue_id"].alias("issue_id"), outcome.alias("outcome"), F.when(done, target).alias("target"), new.alias("outdated"))
        return F.struct(F.when(done, target).otherwise(state["target"]).alias("target"), issues.alias("issues"), F.concat(state["log"], F.array(entry)).alias("log")).cast(STATE)

    found = F.filter(state["issues"], lambda i: i["issue_id"] == edit["issue_id"])
    return _let(F.get(found, F.lit(0)), with_issue)


def applied(paragraphs: DataFrame, issues: DataFrame, edits: DataFrame) -> DataFrame:
    """paragraph_id, target, issues, log per paragraph with edits: its text and issues after them, and what became of each edit.

    paragraphs: paragraph_id (unique), target. issues: issue_id, paragraph_id, fragment, suggestion, status. edits: paragraph_id,
    issue_id, place (their order). An edit accepts an open issue: its suggestion takes the place of its fragment, and other
    open issues whose fragment the new text no longer holds are outdated. Without the issue, an open one, a suggestion
    that is no advice, or the fragment in the text, an edit changes nothing and says why. log has an entry an edit,
    with the revision's text. Edits of a paragraph depend on one another, so its issues and edits meet in one row.
    """
    own = issues.select("paragraph_id", F.struct(F.col("issue_id").cast("long").alias("issue_id"), "fragment", "suggestion", "status").alias("i")).groupBy("paragraph_id").agg(F.sort_array(F.collect_list("i")).cast(ISSUES).alias("issues"))
    asked = edits.select("paragraph_id", F.struct(F.col("place").cast("long").alias("place"), F.col("issue_id").cast("long").alias("issue_id")).alias("e")).groupBy("paragraph_id").agg(F.sort_array(F.collect_list("e")).alias("edits"))
    rows = paragraphs.select("paragraph_id", F.coalesce("target", F.lit("")).alias("target")).join(asked, "paragraph_id").join(own, "paragraph_id", "left")
    start = F.struct(F.col("target").alias("target"), F.coalesce("issues", F.array().cast(ISSUES)).alias("issues"), F.array().alias("log")).cast(STATE)
    return rows.select("paragraph_id", F.aggregate("edits", start, _applied).alias("s")).select("paragraph_id", "s.*")

"""Links of pages: relative targets, unquoted values, every tag, long tags."""

import pytest
from pyspark.sql import functions as F

from lexigauge.llm import urls

REFRESH = '<meta http-equiv="refresh" content="0;url={}">'
BLOCKED = "http://x.com/de/b"


def test_relative_targets(spark):
    page = "http://x.com/de/b/c.html?q=1#t"
    want = {
        "page2.html": "http://x.com/de/b/page2.html", "./p": "http://x.com/de/b/p", "../x": "http://x.com/de/x", "../../../x?y#z": "http://x.com/x?y#z", "..": "http://x.com/de/", "?p=2": "http://x.com/de/b/c.html?p=2",
        "/a/../b": "http://x.com/b", "//y.org/a": "http://y.org/a", "https://y.org": "https://y.org", "/go?to=http://y.org/../a": "http://x.com/go?to=http://y.org/../a", "mailto:a@b.c": None,
    }
    rows = spark.createDataFrame([(k, page) for k in want], "to string, url string")
    assert dict(map(tuple, rows.select("to", urls._absolute(F.col("to"), F.col("url"))).collect())) == want
    bare = spark.createDataFrame([("a", "http://x.com"), ("b", "nonsense")], "to string, url string")
    assert [r[0] for r in bare.select(urls._absolute(F.col("to"), F.col("url"))).collect()] == ["http://x.com/a", None]


@pytest.mark.parametrize(
    "html",
    [
        REFRESH.format("de/b"),
        REFRESH.format("../up/../de/b"),
        "<meta http-equiv=refresh content=0;url=de/b>",
        "<META content='3; URL=/de/b' HTTP-EQUIV=Refresh>",
        "<link rel=canonical href=/de/b>",
        "<link href='http://x.com/de/b' rel='shortlink canonical'/>",
        "<link rel=canonical href=/elsewhere><link rel=canonical href=/de/b>",
        REFRESH.format("/elsewhere") + REFRESH.format("/de/b"),
        f'<link title="a > b {"x" * 3000}" rel="canonical" href="/de/b">',
        f'<meta name="{"n" * 3000}" http-equiv="refresh" content="0; url=/de/b">',
    ],
)
def test_an_alias_of_a_blocked_page_is_blocked(spark, html):
    rows = [(1, "http://x.com/alias", html), (2, BLOCKED, ""), (3, "http://x.com/other", '<link rel="stylesheet" href="/de/b"><a href="/de/b">')]
    got = {r["page_id"]: (r["verdict"], r["via"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "rule"), 3: ("allow", "default")}

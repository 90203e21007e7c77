"""Every cue of the licence scan holds a hint; components without an edge or a loop."""

import itertools
import re

from lexigauge.llm import licenses
from lexigauge.llm.common import components


def test_cues_hold_hints():
    said = [f"{a}{s}{b}" for a, b in (("cc", "by"), ("cc", "0"), ("apache", "2"), ("mpl", "2"), ("bsd", "2"), ("bsd", "3")) for s in ("", " ", "-")]
    said += ["licensed", "licence", "Copyright", "SPDX", "permission", "redistribution", "public domain", "creative commons", "gpl", "agpl", "lgpl", "algpl", "All rights reserved", "without warranty", "free software"]
    hit = [t for t in map(" ".join, itertools.product(["x"], said, ["y"])) if re.search(licenses.CUE, t)]
    assert len(hit) > 25 and all(any(h in t.lower() for h in licenses.HINTS) for t in hit)


def test_components_without_edges(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert components(empty).collect() == []
    loops = spark.createDataFrame([("x", "x"), (None, "y")], "a string, b string")
    assert [tuple(r) for r in components(loops).collect()] == [("x", "x")]


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "a long, b long")
    assert dict(map(tuple, components(chain).collect())) == {i: 0 for i in range(10)} | {20: 20, 21: 20}

"""Greedy span claims against a plain quadratic version."""

from hypothesis import given
from hypothesis import strategies as st

from lexigauge.operators import spans


def plain(text, surfaces):
    free, out = [True] * len(text), []
    for s in sorted(dict.fromkeys(x for x in surfaces if x), key=len, reverse=True):
        at = 0
        while at + len(s) <= len(text):
            if text[at : at + len(s)] == s and all(free[at : at + len(s)]):
                free[at : at + len(s)] = [False] * len(s)
                out.append((at, at + len(s), s))
            at += 1
    return sorted(out)


@given(st.text("ab ", max_size=40), st.lists(st.text("ab ", max_size=4), max_size=6))
def test_claimed(text, surfaces):
    assert spans.claimed(text, surfaces) == plain(text, surfaces)


def test_claim(spark):
    rows = spark.createDataFrame([(1, "ab abc", ["ab", "abc"]), (2, None, ["a"]), (3, "x", None), (4, "", [])], "id long, text string, surfaces array<string>")
    assert sorted(map(tuple, spans.claim(rows, "id").collect())) == [(1, 0, 2, "ab"), (1, 3, 6, "abc")]

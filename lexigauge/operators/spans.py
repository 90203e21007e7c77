"""Spans claimed in texts."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claimed(text: str, surfaces: list[str]) -> list[tuple[int, int, str]]:
    """Every occurrence of each surface, the longest surfaces first, that overlaps no span claimed before; by start.

    Occurrences of a surface are counted off from the left without overlap, claimed or not.
    """
    starts, ends = [], {}
    for s in sorted(dict.fromkeys(x for x in surfaces if x), key=len, reverse=True):
        at = text.find(s)
        while at >= 0:
            i = bisect.bisect_left(starts, at)
            if (i == 0 or ends[starts[i - 1]][0] <= at) and (i == len(starts) or starts[i] >= at + len(s)):
                starts.insert(i, at)
                ends[at] = (at + len(s), s)
            at = text.find(s, at + len(s))
    return [(a, *ends[a]) for a in starts]


def claim(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, end, surface) for rows of key, text and surfaces; nulls claim nothing. Each row is worked on by itself."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [(k, *x) for k, t, s in zip(f[key], f["text"], f["surfaces"]) if t is not None and s is not None for x in claimed(t, list(s))]
            yield pd.DataFrame(out, columns=[key, "start", "end", "surface"])

    return rows.select(key, F.col("text"), F.col("surfaces")).mapInPandas(run, f"{key} {kind}, start long, end long, surface string")


def claimed_in_turn(text: str, surfaces: list[str | None]) -> list[tuple[int, int, int]]:
    """(start, end, place from 1) of the first occurrence of each surface that is free when its turn comes.

    Occurrences may overlap themselves; null and empty surfaces and those without a free occurrence claim nothing.
    """
    starts, ends, out = [], {}, []
    for place, s in enumerate(surfaces, 1):
        at = text.find(s) if s else -1
        while at >= 0:
            i = bisect.bisect_left(starts, at)
            if (i == 0 or ends[starts[i - 1]] <= at) and (i == len(starts) or starts[i] >= at + len(s)):
                starts.insert(i, at)
                ends[at] = at + len(s)
                out.append((at, at + len(s), place))
                break
            at = text.find(s, at + 1)
    return out


def claim_in_turn(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, end, place) for rows of key, text and surfaces in their order; nulls claim nothing."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [(k, *x) for k, t, s in zip(f[key], f["text"], f["surfaces"]) if t is not None and s is not None for x in claimed_in_turn(t, list(s))]
            yield pd.DataFrame(out, columns=[key, "start", "end", "place"])

    return rows.select(key, F.col("text"), F.col("surfaces")).mapInPandas(run, f"{key} {kind}, start long, end long, place int")


def shown(length: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int | None]]:
    """(start, end, place, host's place) of the ranges that show: one level deep, one inner range a host.

    A range inside a top one is its inner range, the first such; of equal ranges the last one is the host. Top ranges
    that begin before an earlier one has ended and ranges beyond the text go. By start, hosts first.
    """
    valid = sorted((a, -b, i) for i, (a, b) in enumerate(ranges, 1) if 0 <= a < b <= length)
    top: list[tuple[int, int, int]] = []
    inner: dict[int, tuple[int, int, int]] = {}
    for k, (a, minus, i) in enumerate(valid):
        host = next((t[2] for t in top if t[1] >= -minus), None)
        if host is None and k + 1 < len(valid) and valid[k + 1][:2] == (a, minus):
            host = valid[k + 1][2]
        if host is None:
            top.append((a, -minus, i))
        else:
            inner.setdefault(host, (a, -minus, i))
    out, free = [], 0
    for a, b, i in top:
        if a >= free:
            out.append((a, b, i, None))
            if i in inner:
                out.append((*inner[i], i))
            free = b
    return out


def show(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, end, place, host) by shown() for rows of key, text and ranges (start, end); nulls show nothing."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [(k, *x) for k, n, r in zip(f[key], f["n"], f["ranges"]) for x in shown(int(n), [(y["start"], y["end"]) for y in r])]
            yield pd.DataFrame(out, columns=[key, "start", "end", "place", "host"]).astype({"host": "Int32"})

    there = rows.where("text is not null and ranges is not null").select(key, F.length("text").alias("n"), "ranges")
    return there.mapInPandas(run, f"{key} {kind}, start long, end long, place int, host int")

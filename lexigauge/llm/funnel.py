"""Ordered funnels over one user's events: attempts, their steps, exact percentiles of the steps' times.

Events go to tasks by user and hour, those of an hour's first minutes to the hour before as well, so that every attempt
finds its whole time limit in one task and no user needs one. In a task each kind is one sorted array of int64, in which
user and hour lead and the time follows: searchsorted chains the steps of all attempts at once. Percentiles are exact:
counts in bins of 0.26 seconds name the bin of the wanted rank, and numpy's partition picks it among the bin's times.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, keep, ship

MINUTE = 60_000_000
#: A bin of times is 2^18 microseconds; a task gets so many rows.
BIN_BITS, TASK_ROWS = 18, 200_000


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluding: str | None = None


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), "error"),
    Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    Funnel("C", ("click", "click", "purchase", "view"), "signup"),
)


def micros(df: DataFrame, name: str):
    """Microseconds since 1970 of a timestamp column; those without a zone are read as they stand, whatever the session's zone."""
    at = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    day, minute = F.unix_date(at.cast("date")), F.hour(at) * 60 + F.minute(at)
    return (day * 1440 + minute).cast("long") * MINUTE + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def chained(times: dict[str, np.ndarray], funnel: Funnel, span: int, own: int, within: int):
    """Yields (attempts, time from the step before) of each step. times: sorted keys a kind, `span` for each user and hour.

    Attempts start in the first `own` microseconds of a span only; the rest repeats the next hour's start.
    """
    none = np.zeros(0, np.int64)
    start = times.get(funnel.steps[0], none)
    start = start[start % span < own]
    yield start, np.zeros(len(start), np.int64)
    out, last = times.get(funnel.excluding, none), start
    for kind in funnel.steps[1:]:
        of = times.get(kind, none)
        at = np.searchsorted(of, last, side="right")
        there = at < len(of)
        start, last, at = start[there], last[there], at[there]
        nxt = of[at]
        good = (nxt - start <= within) & (np.searchsorted(out, nxt, side="right") == np.searchsorted(out, last, side="right"))
        start, before, last = start[good], last[good], nxt[good]
        yield start, last - before


def _attempts(funnels, span, own, within):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        user, users = pd.factorize(pdf["who"])
        unit, units = pd.factorize(user.astype(np.int64) << 32 | pd.factorize(pdf["hour"])[0])
        key = unit.astype(np.int64) * span + pdf["off"].to_numpy()
        kind = pdf["kind"].to_numpy()
        times = {k: np.sort(key[kind == k]) for k in pd.unique(kind)}
        owner, parts = units >> 32, []
        for f in funnels:
            found = [(owner[start // span] << 3 | step) * (within + 1) + took for step, (start, took) in enumerate(chained(times, f, span, own, within), 1)]
            code, n = np.unique(np.concatenate(found), return_counts=True)
            where = code // (within + 1)
            parts.append(pd.DataFrame({"funnel": f.name, "who": users[where >> 3], "step": (where & 7).astype(np.int32), "took": code % (within + 1), "n": n}))
        return pd.concat(parts)

    return run


def _selected(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each group's times in a bin (with counts) the one of the wanted rank."""
    pdf = pdf.assign(g=pdf.groupby(["funnel", "who", "step"], sort=False).ngroup())
    g, low, n = pdf["g"].to_numpy(np.int64), pdf["took"].to_numpy() & ((1 << BIN_BITS) - 1), pdf["n"].to_numpy()
    groups = pdf.drop_duplicates("g").sort_values("g")
    rank, base = groups["rank"].to_numpy(), groups["took"].to_numpy() >> BIN_BITS << BIN_BITS
    total, rows = np.bincount(g, n, len(groups)).astype(np.int64), np.bincount(g, minlength=len(groups))
    out = np.zeros(len(groups), np.int64)
    few = total <= 64 * rows  # mostly different times: partition all of them
    key = np.repeat((g << BIN_BITS | low)[few[g]], n[few[g]])
    at = (np.cumsum(np.where(few, total, 0)) - total + rank - 1)[few]
    out[few] = np.partition(key, at)[at] if len(at) else 0
    order = np.argsort(g << BIN_BITS | low)  # times that repeat a great deal: by their counts
    order = order[~few[g[order]]]
    cum = np.cumsum(n[order])
    at = (np.cumsum(np.where(few, 0, total)) - total + rank)[~few]
    out[~few] = (g << BIN_BITS | low)[order][np.searchsorted(cum, at)] if len(at) else 0
    return pd.DataFrame({"funnel": groups["funnel"], "who": groups["who"], "step": groups["step"], "t": base + (out & ((1 << BIN_BITS) - 1))})


def count(events: DataFrame, who: str = "client_id", kind: str = "kind", at: str = "arrived_at", funnels=FUNNELS, within: int = 5 * MINUTE, percent: int = 25, hour: int = 60 * MINUTE) -> DataFrame:
    """One row per funnel and user with an attempt: funnel, who, n1.., deepest, t2.., same_depth.

    Rows with a null in one of the three columns and rows repeated in them don't count; empty tables give no rows; other
    columns are not read. Each row of a first step is an attempt. Later steps are the earliest rows of their kind strictly
    after the step before, `within` microseconds of the first one at most, with no excluded row after the step before up to
    and with the new one. t: the time of rank ceil(percent * n / 100) of a step's n times, null without any. Rows at equal
    times are in no order: none is later. same_depth counts the users of equal funnel and deepest step.

    A task holds some 200,000 rows and one user's `hour` more; nothing goes to the driver but the count of the rows.
    """
    spark = events.sparkSession
    ship(spark)
    depth = {len(f.steps) for f in funnels}
    if len(depth) != 1 or not 2 <= (most := depth.pop()) <= 7:
        raise ValueError("funnels of one call have the same number of steps, 2 to 7")
    if hour < within:
        raise ValueError("hour must hold the time limit of an attempt")
    names = sorted({k for f in funnels for k in (*f.steps, f.excluding) if k is not None})
    rows = events.select(F.col(who).alias("who"), F.col(kind).alias("kind"), micros(events, at).alias("us")).where(F.col("kind").isin(names) & F.col("who").isNotNull() & F.col("us").isNotNull()).distinct()
    shares = max(1, -(-events.count() // TASK_ROWS))
    off = F.pmod("us", F.lit(hour))
    first = F.expr("(us - off) div " + str(hour))
    rows = rows.withColumn("off", off).withColumn("hour", first)
    ahead = F.struct((F.col("hour") - 1).alias("hour"), (F.col("off") + hour).alias("off"))
    here = F.struct("hour", "off")
    rows = rows.select("who", "kind", F.explode(F.when(F.col("off") < within, F.array(here, ahead)).otherwise(F.array(here))).alias("x")).select("who", "kind", "x.*")
    rows = rows.withColumn("share", F.pmod(F.xxhash64("who", "hour"), F.lit(shares)))
    type_of = events.schema[who].dataType.simpleString()
    made = rows.groupBy("share").applyInPandas(_attempts(tuple(funnels), hour + within, hour, within), f"funnel string, who {type_of}, step int, took long, n long")
    made = keep(made)

    group = ["funnel", "who", "step"]
    later = made.where("step > 1").withColumn("bin", F.shiftright("took", BIN_BITS))
    bins = later.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    upto, whole = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*group)
    bins = bins.select(*group, "bin", "n", F.sum("n").over(upto).alias("upto"), F.expr(f"(sum(n) over (partition by funnel, who, step) * {percent} + 99) div 100").alias("want"))
    hit = bins.where("want <= upto and want > upto - n").select(*group, "bin", (F.col("want") - F.col("upto") + F.col("n")).alias("rank"))
    times = later.join(hit, [*group, "bin"]).groupBy(*group, "took").agg(F.sum("n").alias("n"), F.first("rank").alias("rank"))
    times = times.withColumn("share", F.pmod(F.xxhash64(*group), F.lit(shares)))
    found = times.groupBy("share").applyInPandas(_selected, f"funnel string, who {type_of}, step int, t long")

    both = made.select(*group, "n", F.lit(None).cast("long").alias("t")).unionByName(found.select(*group, F.lit(0).cast("long").alias("n"), "t"))
    n = [F.coalesce(F.sum(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).cast("long").alias(f"n{k}") for k in range(1, most + 1)]
    t = [F.max(F.when(F.col("step") == k, F.col("t"))).alias(f"t{k}") for k in range(2, most + 1)]
    users = keep(both.groupBy("funnel", "who").agg(*n, F.max("step").cast("int").alias("deepest"), *t))
    drop(made)
    same = users.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # a row for each step of each funnel at most
    out = users.join(F.broadcast(same), ["funnel", "deepest"])
    return out.select("funnel", F.col("who").alias(who), *[f"n{k}" for k in range(1, most + 1)], "deepest", *[f"t{k}" for k in range(2, most + 1)], "same_depth")


def sql(funnels=FUNNELS, within: int = 5 * MINUTE) -> str:
    """The same result of the table clicks in DuckDB's SQL, by ASOF joins."""
    parts = []
    for f in funnels:
        before = f"select client_id, t as t1, t as last, 1 as step, cast(null as bigint) as took from e where kind = '{f.steps[0]}'"
        steps = [f"s1 as materialized ({before})"]
        for k, kind in enumerate(f.steps[1:], 2):
            nxt = f"select s.client_id, s.t1, s.last, x.t as nxt from s{k - 1} s asof join (select client_id, t from e where kind = '{kind}') x on s.client_id = x.client_id and s.last < x.t"
            shut = f"select n.*, y.t as shut from ({nxt}) n asof left join (select client_id, t from e where kind = '{f.excluding}') y on n.client_id = y.client_id and n.last < y.t"
            steps.append(f"s{k} as materialized (select client_id, t1, nxt as last, {k} as step, nxt - last as took from ({shut}) where nxt - t1 <= {within} and (shut is null or shut > nxt))")
        rows = " union all ".join(f"select '{f.name}' as funnel, client_id, step, took from s{k}" for k in range(1, 5))
        parts.append(f"select * from (with {', '.join(steps)} {rows})")
    return f"""
with e as materialized (select distinct client_id, kind, epoch_us(arrived_at) as t from clicks where client_id is not null and kind is not null and arrived_at is not null),
a as materialized ({" union all ".join(parts)}),
r as (select *, row_number() over (partition by funnel, client_id, step order by took) as k, count(*) over (partition by funnel, client_id, step) as n from a),
u as (select funnel, client_id, {", ".join(f"cast(count(*) filter (step = {k}) as bigint) as n{k}" for k in range(1, 5))}, cast(max(step) as integer) as deepest,
 {", ".join(f"max(took) filter (step = {k} and k = (25 * n + 99) // 100) as t{k}" for k in range(2, 5))} from r group by 1, 2)
select *, count(*) over (partition by funnel, deepest) as same_depth from u"""

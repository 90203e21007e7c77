"""Licence paragraphs: sparse word n-gram logistic regression, calibrated, confirmed by comparison with templates.

The classifier is trained on the templates below, their wordings and plain counterexamples, all listed here; training
is a small fixed job on the driver. Scoring is a plan of built-in functions: candidate runs of lines, their word n-grams
joined with the weights, sums, softmax at the calibrated temperature, and the share of a template's words that the run holds.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

# Families, their names and identifiers, and what reuse they stand for.
FAMILIES = {
    "AGPL": (("GNU Affero General Public License", "AGPL-3.0", "AGPLv3"), "copyleft"),
    "Apache": (("Apache License, Version 2.0", "Apache-2.0", "Apache License 2.0", "Apache 2.0"), "permissive"),
    "BSD": (("BSD License", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD License", "2-clause BSD License"), "permissive"),
    "CC-BY": (("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"), "permissive"),
    "CC-BY-NC": (("CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), "noncommercial"),
    "CC-BY-SA": (("CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), "copyleft"),
    "CC0": (("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"), "permissive"),
    "GPL": (("GNU General Public License, version 3", "GNU General Public License, version 2", "GPL-3.0", "GPL-2.0", "GPLv3", "GPLv2"), "copyleft"),
    "ISC": (("ISC License", "ISC"), "permissive"),
    "LGPL": (("GNU Lesser General Public License", "LGPL-2.1", "LGPL-3.0", "LGPLv3"), "copyleft"),
    "MIT": (("MIT License", "MIT", "Expat License"), "permissive"),
    "MPL": (("Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0"), "copyleft"),
    "Proprietary": (("proprietary license", "commercial license"), "restricted"),
    "Unlicense": (("The Unlicense", "Unlicense"), "permissive"),
}
TEXTS = {
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "Apache": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "GPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved. No part of this publication may be reproduced without the prior written permission of the copyright holder.",),
}
WORDINGS = ("{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}", "Distributed under the terms of the {}", "SPDX-License-Identifier: {}", "License: {}", "The code is available under the {}, see LICENSE.")
NONE, UNKNOWN = "none", "unknown"
OTHERS = (
    "The driver lost a license after the accident.", "Fishing requires a license from the state.", "He studied at MIT and later moved to Berkeley.", "The Apache helicopter flew over the valley.", "The Apache people of the southwest.",
    "All rights of the workers were reserved.", "Public domain of the town council.", "She took creative writing and commons law.", "Copyright law is taught in the second year.", "The committee granted permission to build.",
    "The general public was invited.", "The version number was changed twice.", "Work on the road is under way, terms agreed.", "A poetic license with the facts.", "The bar has a license to sell spirits.", "They redistribute food to the poor.",
    "The software was sold with a warranty.", "This work is under review by the board.", "Released under pressure, the report was late.", "The terms of the agreement are secret.", "The mozilla browser was popular.", "The gnu is a large antelope.", "By the way, cc me on the mail.", "The bsd and isc groups met at noon.",
)
#: A run of lines is a candidate if it holds one of these; a bare name that is also a word (mit, isc) is no notice by itself.
CUES = ("licen[sc]", "copyright", "spdx", "permission", "redistribut", "public domain", "creative commons", r"\bcc[ -]?(?:by|0)", r"\ba?l?gpl", "all rights reserved", "without warrant", "free software", r"\bapache[ -]2", r"\bmpl[ -]?2", r"\bbsd-[23]")
CUE = "(?i)" + "|".join(CUES)
#: Every cue holds one of these; texts without any need no look at their lines.
HINTS = ("licens", "licenc", "copyright", "spdx", "permission", "redistribut", "public domain", "creative commons", "ccby", "cc by", "cc-by", "cc0", "cc 0", "cc-0", "gpl", "all rights reserved", "without warrant", "free software", "apache 2", "apache-2", "mpl2", "mpl 2", "mpl-2", "bsd-2", "bsd-3")
#: Marks that comments put before each line, and the cues that a line break can be within.
LEADER = r"^[\s#*/;%>|!-]+"
BROKEN = (("public", "domain"), ("creative", "commons"), ("all", r"rights\s+reserved"), (r"all\s+rights", "reserved"), ("without", "warrant"), ("free", "software"), ("cc", "(?:by|0)"), ("apache", "2"), ("mpl", "2"))
CROSSING = "(?i)" + "|".join(rf"\b{a}[^\S\n]*\n[\s#*/;%>|!-]*{b}" for a, b in BROKEN)
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: A family needs this probability, and the run of lines this share of the words of one of its templates.
LEAST_P, LEAST_SHARE = 0.5, 0.75


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def ngrams(text: str) -> set[str]:
    t = tokens(text)
    return {*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))}


def labelled() -> list[tuple[str, str]]:
    """(family, paragraph): every wording of every name, the texts and their halves, and paragraphs of no family."""
    out = [(f, w.format(name)) for f, (names, _) in FAMILIES.items() for name in names for w in WORDINGS]
    for f, texts in TEXTS.items():
        for t in texts:
            w = t.split()
            out += [(f, t), (f, " ".join(w[: len(w) * 2 // 3])), (f, " ".join(w[len(w) // 3 :]))]
    return out + [(NONE, t) for t in OTHERS for _ in range(6)]


def templates() -> list[tuple[str, list[str]]]:
    """(family, its words) of the names and texts; words that any notice has don't tell a family."""
    plain = {"the", "of", "a", "and", "to", "in", "or", "this", "is", "by", "for", "with", "license", "version", "international"}
    rows = [(f, {t for t in tokens(n) if t not in plain}) for f, (names, _) in FAMILIES.items() for n in names]
    rows += [(f, set(tokens(t))) for f, ts in TEXTS.items() for t in ts]
    return sorted({(f, tuple(sorted(w))) for f, w in rows if w})


@functools.lru_cache(1)
def train(epochs: int = 300, rate: float = 0.5, l2: float = 1e-3):
    """(classes, weights by n-gram, bias, temperature); every fifth paragraph calibrates the temperature."""
    rows = labelled()
    classes = [*sorted(FAMILIES), NONE]
    vocab = {g: i for i, g in enumerate(sorted({g for _, t in rows for g in ngrams(t)}))}
    x = np.zeros((len(rows), len(vocab)))
    for i, (_, t) in enumerate(rows):
        g = [vocab[k] for k in ngrams(t)]
        x[i, g] = 1 / np.sqrt(len(g))
    y = np.eye(len(classes))[[classes.index(f) for f, _ in rows]]

    def fit(x, y):
        w, b, sw, sb = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1]), 1e-8, 1e-8
        for _ in range(epochs):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - y) / len(y)
            gw, gb = x.T @ d + l2 / 10 * w, d.sum(0)
            sw, sb = sw + gw**2, sb + gb**2
            w, b = w - rate * gw / np.sqrt(sw), b - rate * gb / np.sqrt(sb)
        return w, b

    out = np.arange(len(rows)) % 5 == 4
    w, b = fit(x[~out], y[~out])

    def loss(t):
        z = (x[out] @ w + b) / t
        z -= z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - (z * y[out]).sum(1)).mean())

    temperature = min((0.25 * 1.15**k for k in range(25)), key=loss)
    w, b = fit(x, y)
    return classes, {g: w[i] for g, i in vocab.items()}, b, temperature


def predict(text: str) -> tuple[str, float]:
    """One paragraph's class and probability, as the plan below finds them; the tests hold one against the other."""
    classes, weights, bias, temperature = train()
    g = ngrams(text)
    z = (bias + sum((weights[k] for k in g if k in weights), np.zeros(len(classes))) / np.sqrt(max(1, len(g)))) / temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return classes[int(p.argmax())], float(p.max())


def _fixed(spark, rows, columns: list[str]) -> DataFrame:
    """A list of this module as a table, read from a JSON literal."""
    text = json.dumps([dict(zip((c.split()[0] for c in columns), r)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in columns)}>>")).alias("r")).select("r.*")


def span() -> int:
    """Words of the longest template: what lies between the first and the last line of a notice has no more."""
    return max(len(tokens(t)) for f, (names, _) in FAMILIES.items() for t in (*names, *TEXTS.get(f, ())))


def _places(lines: Column) -> Column:
    """Of every line that holds a cue, or in which one begins that the next line ends: its number, and the lines that a notice on it can span."""
    far = span() + 1
    cue = lambda x, i: x.rlike(CUE) | F.coalesce(F.concat(x, F.lit("\n"), F.get(lines, i + 1)).rlike(CROSSING), F.lit(False))
    first = lambda i: F.greatest(i - far, F.lit(0))
    near = lambda i: F.struct(i.alias("at"), first(i).alias("first"), F.slice(lines, first(i) + 1, F.lit(2 * far + 1) - (far - (i - first(i)))).alias("lines"))
    return F.filter(F.transform(lines, lambda x, i: F.when(cue(x, i), near(i))), lambda x: x.isNotNull())


def runs(places: DataFrame) -> DataFrame:
    """Rows with a `place` to their columns and a, b, paragraph: every run of lines a to b over the place that holds a cue.

    Lines without a word part paragraphs, no run goes beyond them. Of the lines of a run all but the first and the last
    have no more words than the longest template; so whatever the wrapping, a template's text has a run that holds it.
    """
    most, rest = span(), [c for c in places.columns if c != "place"]
    p = places.select(*rest, "place.*").withColumn("w", F.transform("lines", lambda x: F.size(F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0)))))
    k = F.col("at") - F.col("first")
    total = lambda i, n: F.aggregate(F.slice("w", i + 1, n), F.lit(0), lambda t, x: t + x)
    worded = lambda i, n: F.array_min(F.slice("w", i + 1, n)) > 0
    start = F.filter(F.sequence(F.lit(0), k), lambda i: (i == k) | (worded(i, k - i + 1) & (total(i + 1, k - i - 1) <= most)))
    end = F.filter(F.sequence(k, F.size("lines") - 1), lambda j: (j == k) | (worded(k, j - k + 1) & (total(k + 1, j - k - 1) <= most)))
    p = p.select(*rest, "first", "lines", "w", F.explode(start).alias("i"), end.alias("ends")).select("*", F.explode("ends").alias("j"))
    i, j = F.col("i"), F.col("j")
    p = p.where((j - i < 2) | (total(i + 1, F.greatest(j - i - 1, F.lit(0))) <= most))
    joined = F.concat_ws(" ", F.transform(F.slice("lines", i + 1, j - i + 1), lambda x: F.regexp_replace(x, LEADER, "")))
    text = F.when(i == j, F.get("lines", i)).otherwise(joined)
    return p.select(*rest, (F.col("first") + i).alias("a"), (F.col("first") + j).alias("b"), text.alias("paragraph")).where(F.col("paragraph").rlike(CUE))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(paragraph, family, p, share): every distinct candidate run of lines with its class; `unknown` if unsure or unconfirmed."""
    lines = docs.select(F.split("text", "\n", -1).alias("all"))
    return classify(runs(lines.select(F.explode(_places(F.col("all"))).alias("place"))).select("paragraph"))


def classify(lines: DataFrame) -> DataFrame:
    spark = lines.sparkSession
    classes, weights, bias, temperature = train()
    lines = keep(lines.distinct())
    t = F.regexp_extract_all(F.lower("paragraph"), F.lit(TOKEN), F.lit(0))
    pairs = F.when(F.size("t") > 1, F.transform(F.slice("t", 1, F.size("t") - 1), lambda x, i: F.concat_ws(" ", x, F.element_at("t", i + 2)))).otherwise(F.array().cast("array<string>"))
    lines = lines.select("paragraph", t.alias("t")).select("paragraph", F.array_distinct("t").alias("words"), F.array_distinct(F.concat("t", pairs)).alias("g"))
    # weights and templates are fixed lists of this module, a few hundred kilobytes at most
    table = F.broadcast(_fixed(spark, [[g, *map(float, w)] for g, w in weights.items()], ["gram string", *(f"w{i} double" for i in range(len(classes)))]))
    grams = lines.select("paragraph", F.size("g").alias("n"), F.explode("g").alias("gram")).join(table, "gram")
    sums = grams.groupBy("paragraph").agg(F.first("n").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(classes))])
    z = [(F.col(f"w{i}") / F.sqrt("n") + float(bias[i])) / float(temperature) for i in range(len(classes))]
    best = F.array_max(F.array(*[F.struct(v.alias("z"), F.lit(c).alias("c")) for v, c in zip(z, classes)]))
    scored = sums.select("paragraph", best.alias("b"), F.array(*z).alias("z"))
    p = 1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("b.z")))
    scored = scored.select("paragraph", F.col("b.c").alias("class"), p.alias("p"))
    known = _fixed(spark, templates(), ["class string", "template array<string>"]).groupBy("class").agg(F.collect_list("template").alias("templates"))
    share = F.array_max(F.transform("templates", lambda w: F.size(F.array_intersect(w, "words")) / F.size(w)))
    out = lines.select("paragraph", "words").join(scored, "paragraph").join(F.broadcast(known), "class", "left").select("paragraph", "class", "p", F.coalesce(share, F.lit(0.0)).alias("share"))
    sure = (F.col("p") >= LEAST_P) & (F.col("share") >= LEAST_SHARE)
    return out.select("paragraph", F.when(F.col("class") == NONE, NONE).when(sure, F.col("class")).otherwise(UNKNOWN).alias("family"), "p", "share")


def _notices(sure: Column) -> Column:
    """Runs that share no line, best first: the larger share of a template, then the more probable, then the shorter."""
    order = F.reverse(F.array_sort(F.transform(sure, lambda x: F.struct(x["share"], x["p"], (x["a"] - x["b"]).alias("short"), (-x["a"]).alias("early"), x["a"], x["b"], x["family"]))))
    kept = F.transform(order, lambda x: F.struct(x["a"], x["b"], x["family"]))
    none = F.array().cast("array<struct<a:int,b:int,family:string>>")
    return F.aggregate(kept, none, lambda got, x: F.when(F.exists(got, lambda y: (x["a"] <= y["b"]) & (y["a"] <= x["b"])), got).otherwise(F.concat(got, F.array(x))))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: n_lines (with a word), n_candidates, n_licence, n_unknown, families (sorted, comma-joined), uses.

    Lines are split at \\n. A null text has none. n_candidates: lines that hold a cue, or in which one begins. n_licence:
    notices, each a line or a run of lines; no two share a line. n_unknown: candidates outside notices that are `unknown`
    by themselves. uses: the reuse classes of the families, sorted, or null.
    """
    # a match starts at the first mark of a line that isn't blank and takes the rest of it
    n_lines = F.coalesce(F.regexp_count("text", F.lit(r"\S[^\n]*")), F.lit(0))
    hint = functools.reduce(lambda x, y: x | y, [F.col("low").contains(h) for h in HINTS]) | F.col("text").rlike(CROSSING)
    # texts are read once; only counts and the lines around candidates are kept
    rows = docs.select("doc_id", "text", F.lower("text").alias("low"))
    rows = rows.select("doc_id", n_lines.cast("long").alias("n_lines"), F.when(hint, F.split("text", "\n", -1)).alias("all"))
    places = F.coalesce(F.when(F.col("all").isNotNull(), _places(F.col("all"))), F.array().cast("array<struct<at:int,first:int,lines:array<string>>>"))
    rows = keep(rows.select("doc_id", "n_lines", places.alias("cand")))
    hit = rows.where(F.size("cand") > 0).withColumn("row", F.monotonically_increasing_id())
    each = keep(runs(hit.select("row", F.explode("cand").alias("place"))).distinct())
    found = keep(classify(each.select("paragraph")).where(F.col("family") != NONE))
    sure = F.col("family") != UNKNOWN
    met = each.join(found, "paragraph").where(sure | (F.col("a") == F.col("b")))
    met = met.groupBy("row").agg(F.collect_list(F.when(sure, F.struct("share", "p", "a", "b", "family"))).alias("sure"), F.collect_list(F.when(~sure, F.col("a"))).alias("unsure"))
    met = met.select("row", _notices(F.col("sure")).alias("got"), "unsure")
    uses = F.create_map(*[F.lit(x) for f, (_, u) in FAMILIES.items() for x in (f, u)])
    met = met.select("row", F.size("got").cast("long").alias("n_licence"), F.size(F.filter("unsure", lambda k: ~F.exists("got", lambda y: (y["a"] <= k) & (k <= y["b"])))).cast("long").alias("n_unknown"), F.sort_array(F.array_distinct(F.col("got.family"))).alias("f"))
    per = hit.select("row", "doc_id", "n_lines", F.size("cand").cast("long").alias("n_candidates")).join(met, "row", "left")
    zero, f = F.lit(0).cast("long"), F.coalesce("f", F.array().cast("array<string>"))
    per = per.select("doc_id", "n_lines", "n_candidates", F.coalesce("n_licence", zero).alias("n_licence"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.concat_ws(",", f).alias("families"), F.concat_ws(",", F.sort_array(F.array_distinct(F.transform(f, lambda x: uses[x])))).alias("uses"))
    rest = rows.where(F.size("cand") == 0).select("doc_id", "n_lines", zero.alias("n_candidates"), zero.alias("n_licence"), zero.alias("n_unknown"), F.lit("").alias("families"), F.lit("").alias("uses"))
    return per.unionByName(rest)

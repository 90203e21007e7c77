"""Sentences, capitalised runs and model replies, from which term mentions are made."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

# Abbreviations that end in a full stop, categories a reply may name, a run of capitalised words.
ABBREVIATIONS = ("н", "э", "в", "вв", "г", "гг", "др", "т", "д", "п", "см", "ок")
CATEGORIES = ("person", "place", "people", "title", "social", "institution", "dynasty", "culture", "language", "realia", "event", "deity", "work", "religion", "other")
CAPITALISED = r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ]?[а-яё]+)*(?:\s+[А-ЯЁ][а-яё]+(?:-[А-ЯЁ]?[а-яё]+)*)*"


NEXT, QUOTED_OR_BRACKET = re.compile(r"\S"), re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[\]]', re.S)


def _ends(text: str, at: int) -> bool:
    """Whether the sign at a place, which white space or the end follows, ends a sentence."""
    if text[at] != ".":
        return True
    word = re.search(r"[^\W\d_]*\Z", text[max(0, at - 40) : at])[0]
    after = NEXT.search(text, at + 1)
    return not (len(word) == 1 or word.lower() in ABBREVIATIONS or (after and after[0].isalpha() and after[0].islower()))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without the white space between them."""
    out, start = [], 0
    for m in re.finditer(r"[.!?…](?=(\s+)|\Z)", text):
        if m.start() >= start and _ends(text, m.start()):
            out.append((start, m.end()))
            start = m.end(1) if m[1] else m.end()
    return out + [(start, len(text))] * (start < len(text))


def context(text: str, start: int, end: int) -> str:
    """All sentences that a span touches, stripped; the span itself if it touches none."""
    touched = [(a, b) for a, b in sentences(text) if a < end and start < b]
    return (text[touched[0][0] : touched[-1][1]] if touched else text[start:end]).strip()


def capitalised(text: str) -> list[str]:
    """Runs of capitalised words, each once; a single word that starts a sentence is none."""
    out: dict[str, None] = {}
    for m in re.finditer(CAPITALISED, text):
        at = m.start()
        while at and text[at - 1].isspace():
            at -= 1
        opens = not at or (at < m.start() and text[at - 1] in ".!?…»)")
        if not opens or re.search(r"[ -]", m[0]):
            out[m[0]] = None
    return list(out)


def first_array(reply: str) -> str | None:
    """The first balanced [...] of a reply; brackets in JSON strings don't count."""
    for opening in re.finditer(r"\[", reply):
        depth = 0
        for m in QUOTED_OR_BRACKET.finditer(reply, opening.start()):
            depth += {"[": 1, "]": -1}.get(m[0], 0)
            if not depth:
                return reply[opening.start() : m.end()]
    return None


def parse(reply: str | None) -> list[dict] | None:
    """[{surface, lemma, category, category_raw}] of a reply's array; None if it has none that can be read."""
    try:
        items = json.loads(first_array(reply or "") or "")
    except ValueError:
        return None
    out = []
    for x in (x for x in items if isinstance(x, dict)):
        surface, lemma = (str(x.get(k) or "").strip() for k in ("surface", "lemma"))
        named = x["category"].strip() if isinstance(x.get("category"), str) else ""
        known = named in CATEGORIES
        if surface:
            out.append({"surface": surface, "lemma": lemma if lemma and len(lemma) <= 80 and "\n" not in lemma else surface, "category": named if known else "other", "category_raw": None if known else named or None})
    return out


def valid(source: str, items: list[dict]) -> tuple[list[dict], int]:
    """Items whose surface the source holds, each surface once, and how many it doesn't hold."""
    held = {}
    for x in items:
        if x["surface"] in source:
            held.setdefault(x["surface"], x)
    return list(held.values()), sum(x["surface"] not in source for x in items)


def contexts(rows: DataFrame) -> DataFrame:
    """rows (text, start, end and others) with context."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def around(t, a, b):
        import pandas as pd

        return pd.Series([None if x is None else context(x, i, j) for x, i, j in zip(t, a, b)], dtype=object)

    return rows.withColumn("context", around("text", "start", "end"))


def surfaces(rows: DataFrame, key: str) -> DataFrame:
    """(key, surface, lemma, category, category_raw, n_dropped) of the valid items in rows' reply; unreadable replies give a row with null surface."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames):
        import pandas as pd

        names = ("surface", "lemma", "category", "category_raw")
        for f in frames:
            out = []
            for k, source, reply in zip(f[key], f["source"], f["reply"]):
                items = parse(reply)
                if items is None:
                    out.append((k, None, None, None, None, 0))
                    continue
                good, dropped = valid(source or "", items)
                out += [(k, *[x[n] for n in names], dropped) for x in good]
            yield pd.DataFrame(out, columns=[key, *names, "n_dropped"])

    return rows.select(key, "source", "reply").mapInPandas(run, f"{key} {kind}, surface string, lemma string, category string, category_raw string, n_dropped long")


def deterministic(rows: DataFrame, key: str, lexicon) -> DataFrame:
    """(key, start, end, surface, category) without a model: capitalised runs, then the lexicon's forms and gentilics, each surface once.

    rows: key (unique), text. Longer surfaces claim their places before shorter ones. Runs have no category. Null and empty texts
    give nothing. lexicon: (form, category) pairs, a table of bounded size.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, StringType

    from lexigauge.functions import forms
    from lexigauge.operators import spans

    @F.pandas_udf(ArrayType(StringType()))
    def runs(texts):
        import pandas as pd

        return pd.Series([capitalised(t or "") for t in texts], dtype=object)

    pair = "array<struct<surface:string,category:string>>"
    listed = rows.select(key, F.coalesce("text", F.lit("")).alias("text")).withColumn("runs", runs("text")).withColumn("known", forms.gazetteer(F.col("text"), lexicon))
    plain = F.transform("runs", lambda s: F.struct(s.alias("surface"), F.lit(None).cast("string").alias("category"))).cast(pair)
    more = F.filter("known", lambda x: ~F.array_contains("runs", x["surface"]))
    listed = listed.select(key, "text", F.concat(plain, more).alias("all"))
    placed = spans.claim(listed.select(key, "text", F.transform("all", lambda x: x["surface"]).alias("surfaces")), key)
    kinds = listed.select(key, F.explode("all").alias("x")).select(key, "x.surface", "x.category")
    return placed.join(kinds, [key, "surface"]).select(key, "start", "end", "surface", "category")

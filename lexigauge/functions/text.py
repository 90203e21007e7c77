"""Scalar text rules as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What advice starts with, and phrases that only advice has.
ADVICE_START = ("consider", "use", "retain", "prefer", "keep", "avoid", "note", "try", "opt for", "replace", "perhaps")
ADVICE_PHRASE = ("the translation", "if needed", "if context requires", "which is the standard", "gloss", "you could", "you might", "you may", "would be better", "instead of")
ADVICE = rf"(?i)^\s*({'|'.join(ADVICE_START)})\b|\b({'|'.join(ADVICE_PHRASE)})\b"


QUOTES = "'\"‘’“”"
QUOTED_CHOICE = rf"[{QUOTES}][^{QUOTES}]+[{QUOTES}]\s*(?:/|\bor\b)\s*[{QUOTES}]"
# Dashes that count as one, and namespaces that hold no articles.
DASHES = "[\u2010-\u2015\u2212]"
NAMESPACES = ("Category:", "File:", "Template:", "Help:", "Wikipedia:", "Talk:", "User:", "Portal:", "Special:", "Media:", "MediaWiki:", "Module:", "Служебная:", "Категория:", "Файл:", "Шаблон:", "Справка:", "Википедия:", "Обсуждение:", "Участник:", "Портал:")


def norm_text(s: str) -> str:
    """A key for comparing labels: NFC, one kind of dash, е for ё, single spaces, case folded."""
    s = re.sub(DASHES, "-", unicodedata.normalize("NFC", s)).replace("ё", "е").replace("Ё", "Е")
    return re.sub(r"\s+", " ", s).strip().casefold()


def norm(c: Column) -> Column:
    """norm_text of a column; Spark has neither NFC nor case folding, so this is an Arrow function. Each kind of value is folded once a batch."""

    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            known = {v: norm_text(v) for v in x.dropna().unique()}
            yield pd.Series([known.get(v) for v in x], dtype=object)

    return fold(c)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def token_index(text: Column, pos: Column) -> Column:
    """How many runs of white space start before a character position."""
    return F.regexp_count(F.substring(text, F.lit(1), pos), F.lit(r"\s+"))


def is_advice(c: Column) -> Column:
    """Starts like advice, holds a phrase of advice, or offers a quoted alternative to something quoted."""
    return F.coalesce(c.rlike(ADVICE) | c.rlike(QUOTED_CHOICE), F.lit(False))


def colour(score: Column) -> Column:
    return F.when(score >= 8, "green").when(score >= 6, "yellow").when(score.isNotNull(), "red")


def verdict(c: Column) -> Column:
    return F.when(c.isin("green", "yellow", "red"), c)


def lemma_or_surface(lemma: Column, surface: Column, most: int = 80) -> Column:
    """A lemma that is there, short and on one line; else the surface."""
    ok = (F.trim(lemma) != "") & (F.length(lemma) <= most) & ~lemma.contains("\n")
    return F.when(ok, lemma).otherwise(surface)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def stems(c: Column, width: int = 4) -> Column:
    return F.array_distinct(F.transform(tokens(F.lower(c)), lambda t: F.substring(t, 1, width)))


def shares_stems(reference: Column, found: Column, least: float = 0.6) -> Column:
    return F.size(F.array_intersect(reference, found)) >= least * F.size(reference)


# What goes from Markdown, in this order; table rows are joined between the two lists.
MARKS = ((r"\r\n", "\n"), (r"(?m)^```[^\n]*$", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\(([^)]*)\)", "$1"), (r"<[^>\n]+>", ""), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""), (r"(?m)^([-*_]){3,}\s*$", ""), (r"(?m)^\|?[\s:|-]+\|[\s:|-]*$", ""))
SPANS = ((r"(\*\*|__)(.*?)\1", "$2"), (r"(\*|_)(?=\S)(.*?)(?<=\S)\1", "$2"), (r"`([^`]*)`", "$1"), (r"\n{3,}", "\n\n"))


def strip_markdown(c: Column) -> Column:
    """Markdown as plain text: fences, images, links, tags, headings, quotes, rules, tables, emphasis and code marks go, their text stays."""
    for pattern, new in MARKS:
        c = F.regexp_replace(c, pattern, new)
    row = "\ue000"  # marks a table row
    c = F.regexp_replace(c, r"(?m)^\|(.+)\|\s*$", f"{row}$1")
    cells = lambda x: F.array_join(F.filter(F.transform(F.split(F.substr(x, F.lit(2)), r"\|"), lambda y: F.trim(y)), lambda y: y != ""), " — ")
    c = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(x.startswith(row), cells(x)).otherwise(x)), "\n")
    for pattern, new in SPANS:
        c = F.regexp_replace(c, pattern, new)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def any_title(href: Column) -> Column:
    """The title in an href that starts with ./ or /wiki/, decoded, without its anchor; null for others."""
    body = F.regexp_extract(href, r"(?s)^(?:\./|/wiki/)([^#]*)", 1)
    title = F.translate(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))), "_", " ")
    return F.when(href.rlike(r"^(?:\./|/wiki/)"), F.coalesce(title, F.translate(body, "_", " ")))


def link_title(href: Column) -> Column:
    """any_title, but null for other namespaces than that of articles."""
    title = any_title(href)
    outside = F.lit(False)
    for prefix in NAMESPACES:
        outside = outside | title.startswith(prefix)
    return F.when(~outside, title)


def signed_year(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?\d{1,6}-"), F.regexp_extract(c, r"^([+-]?\d{1,6})-", 1).cast("int"))


def is_body(line: Column) -> Column:
    """Not empty and not all capitals."""
    return (F.trim(line) != "") & ~((F.upper(line) == line) & line.rlike(r"\p{L}"))

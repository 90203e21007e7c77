"""Display names, clean names and clean replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of languages by code.
LANGUAGES = {"ru": "Russian", "en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "pl": "Polish", "uk": "Ukrainian", "zh": "Chinese", "ja": "Japanese", "ar": "Arabic"}
# Labels that stand before a reply, quotes that may wrap it, and what stands for a picture.
LABEL = r"(?i)^\s*(?:translation|translated text)\s*:\s*"
WRAPPING = "\"'“”‘’"
PICTURE = "<picture>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title_case(c: Column) -> Column:
    """Each word with its first letter large, single blanks; null for none."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    large = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.when(F.size(words) > 0, F.array_join(large, " "))


def language(c: Column) -> Column:
    """The name of a language code; other text as it is, without blanks around it."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(known[F.lower(strip(c))], strip(c))


def language_label(c: Column) -> Column:
    """As shown: a known code's name, other codes as they are, free text with its first letter large."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    code = c.rlike(r"^(?i)[a-z]{2,3}(-[A-Za-z0-9]+)*$")
    return F.coalesce(known[F.lower(c)], F.when(code, c).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))))


def on_one_line(c: Column) -> Column:
    """Without control characters, every run of white space one blank."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.array_join(F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != ""), " ")


def without_label(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), LABEL, ""))


def without_wrapping(c: Column) -> Column:
    """Without a code fence around it, then without one pair of quotes."""
    out = strip(F.regexp_replace(strip(c), r"\A\s*```[a-zA-Z]*\n?|\n?```\s*\z", ""))
    quotes = list(WRAPPING)
    wrapped = (F.length(out) >= 2) & F.substring(out, 1, 1).isin(quotes) & F.right(out, F.lit(1)).isin(quotes)
    return F.when(wrapped, strip(F.substr(out, F.lit(2), F.length(out) - 2))).otherwise(out)


def document_slug(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "document").otherwise(slug)


def storage_name(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))


def file_name(c: Column) -> Column:
    """Letters, digits, marks of words, dashes and dots as they are, anything else an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\-.]", "_")


def run_name(model: Column, provider: Column) -> Column:
    return F.concat(F.replace(model, F.lit("/"), F.lit("--")), F.lit("--"), provider)


def pictures_marked(c: Column) -> Column:
    return F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", PICTURE)


def chapter_blocks(c: Column) -> Column:
    """The blocks between blank lines that are neither headings nor a picture's mark, trimmed."""
    parts = F.transform(F.split(c, r"\n{2,}"), strip)
    return F.filter(parts, lambda p: (p != "") & ~p.startswith("#") & (p != PICTURE))


def blank_line_blocks(c: Column) -> Column:
    """The blocks between lines of white space, trimmed."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def is_body(line: Column, marker: str = "Picture text") -> Column:
    """Neither empty nor the marker nor all capitals."""
    s = strip(line)
    return (s != "") & (s != marker) & ~((F.upper(s) == s) & s.rlike(r"\p{L}"))

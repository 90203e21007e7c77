"""Names of entities, alternates, stems, occurrences and splices of text, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common nouns that are no name by themselves, case endings that are cut from a word, gentilic endings and
# words that only look like gentilics.
COMMON_HEADS = ("kingdom", "empire", "city", "state", "republic", "dynasty", "war", "battle", "sea", "river", "mountain", "gulf", "region", "province", "peace", "treaty", "league", "union", "confederacy", "culture", "period", "lament", "laws", "law")
CASE_ENDINGS = ("иями", "ями", "ами", "иях", "ях", "ах", "ием", "ем", "ом", "ой", "ей", "ий", "ый", "ая", "яя", "ое", "ее", "ую", "юю", "ым", "им", "ых", "их", "а", "я", "о", "е", "у", "ю", "ы", "и", "ь")
GENTILICS = ("цы", "яне", "ане", "еи")
NOT_GENTILICS = ("молодцы", "бойцы", "жрецы", "гонцы", "певцы", "борцы", "жрицы", "трофеи", "владельцы", "границы", "гробницы", "страницы", "ножницы", "единицы")

ENTITY = "labels map<string,struct<value:string>>, aliases map<string,array<struct<value:string>>>, sitelinks map<string,struct<title:string>>, descriptions map<string,struct<value:string>>"
LATIN = "[A-Za-z]"


def entity(json: Column) -> Column:
    """An entity record: labels and descriptions by language, aliases by language, titles by site."""
    return F.from_json(json, ENTITY)


def label(e: Column, lang: str = "en") -> Column:
    return e["labels"][lang]["value"]


def aliases(e: Column, lang: str = "en") -> Column:
    return F.coalesce(F.transform(e["aliases"][lang], lambda a: a["value"]), F.array().cast("array<string>"))


def site_title(e: Column, site: str = "enwiki") -> Column:
    return e["sitelinks"][site]["title"]


def description(e: Column, lang: str = "en") -> Column:
    return F.coalesce(e["descriptions"][lang]["value"], F.lit(""))


def short_form(name: Column) -> Column:
    """The plain name in a full one: what stands before of, the, a kinship or a comma, without a numeral; null for none."""
    head = F.trim(F.split(name, r"(?U)\s+(?:of|the|son|daughter|and)\s+|,\s*", 2)[0])
    head = F.trim(F.regexp_replace(head, r"(?U)\s+(?:[IVXLC]+|[A-Z])$", ""))
    return F.when((head != name) & ~F.lower(head).isin(*COMMON_HEADS) & head.rlike(LATIN), head)


def latin_forms(e: Column) -> Column:
    """Label, aliases, site title and short form of an entity in that order, those with a Latin letter, each once."""
    title = site_title(e)
    known = F.when(F.coalesce(label(e), F.lit("")) != "", label(e)).otherwise(F.coalesce(title, F.lit("")))
    every = F.concat(F.array(label(e)), aliases(e), F.array(title, short_form(known)))
    return F.array_distinct(F.filter(every, lambda f: F.coalesce(f.rlike(LATIN), F.lit(False))))


def _literal(c: Column) -> Column:
    """A pattern that matches exactly c."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def alternates(surface: Column, context: Column) -> Column:
    """What a parenthesis right behind the surface lists, by commas or the conjunction; the first such parenthesis counts."""
    none = F.array().cast("array<string>")
    found = F.regexp_substr(context, F.concat(F.lit("(?U)"), _literal(surface), F.lit(r"\s*\([^)]*\)")))
    inner = F.regexp_extract(found, r"\(([^)]*)\)\z", 1)
    parts = F.filter(F.transform(F.split(inner, r"(?iuU)\s*,\s*|\s*\bили\b\s*"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return F.when((surface != "") & found.isNotNull(), parts).otherwise(none)


def stems(phrase: Column) -> Column:
    """The words in small letters without one case ending: words of five letters on, the longest ending that leaves three."""
    cut = lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, f"^(.{{3,}}?)(?:{'|'.join(CASE_ENDINGS)})$", "$1")).otherwise(w)
    return F.array_join(F.transform(F.split(F.lower(phrase), r"(?U)\s+"), cut), " ")


def occurrences(text: Column, fragment: Column) -> Column:
    """All places (from 0) of a fragment, overlapping ones too; an empty one is at every character."""
    n = F.length(fragment)
    last = F.least(F.length(text) - n, F.length(text) - 1)
    hits = F.filter(F.sequence(F.lit(0), last), lambda i: F.substr(text, i + 1, n) == fragment)
    return F.when((last >= 0) & text.contains(fragment), hits).otherwise(F.array().cast("array<int>"))


def match_span(text: Column, needle: Column) -> Column:
    """The text before, in and after the first hit without regard to case; null for none or an empty needle."""
    at = F.position(F.lower(needle), F.lower(text))
    n = F.length(needle)
    found = F.struct(F.substr(text, F.lit(1), at - 1).alias("before"), F.substr(text, at, n).alias("match"), F.substr(text, at + n).alias("after"))
    return F.when((n > 0) & (at > 0), found)


def sentence_with(text: Column, needle: Column) -> Column:
    """The trimmed sentence in which the first hit without regard to case begins; sentences end at . ! or ? and blanks."""
    at = F.position(F.lower(needle), F.lower(text)) - 1
    parts = F.regexp_extract_all(text, F.lit(r"(?sU).+?(?:[.!?]\s+|\z)"), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast("string").alias("hit"))
    step = lambda a, p: F.struct((a["end"] + F.length(p)).alias("end"), F.coalesce(a["hit"], F.when(a["end"] + F.length(p) > at, p)).alias("hit"))
    hit = F.aggregate(parts, start, step)["hit"]
    return F.when((needle != "") & (at >= 0), F.regexp_replace(hit, r"(?U)^\s+|\s+$", ""))


def spliced(target: Column, fragment: Column, suggestion: Column) -> Column:
    """target with the fragment's first hit replaced; null for none. Blanks in the fragment match any others on a miss.

    A first or last word of the suggestion that the text beside the hit already has is not repeated.
    """
    words = F.filter(F.split(fragment, r"(?U)\s+"), lambda w: w != "")
    loose = F.concat(F.lit("(?U)"), F.array_join(F.transform(words, _literal), "\\s+"))
    exact = F.when(fragment != "", F.position(fragment, target)).otherwise(0)
    by_words = F.when(F.size(words) > 0, F.regexp_instr(target, loose)).otherwise(0)
    at = F.when(exact > 0, exact).otherwise(by_words)
    n = F.when(exact > 0, F.length(fragment)).otherwise(F.length(F.regexp_substr(target, loose)))
    before, after = F.substr(target, F.lit(1), at - 1), F.substr(target, at + n)
    same = lambda a, b: (a != "") & (F.lower(a) == F.lower(b))
    lead = F.regexp_extract(suggestion, r"(?U)^(\S+)(\s+)", 1)
    s = F.when(same(F.regexp_extract(before, r"(?U)(?<!\S)(\S++)\s*+\z", 1), lead), F.regexp_replace(suggestion, r"(?U)^\S+\s+", "")).otherwise(suggestion)
    tail = F.regexp_extract(s, r"(?U)\s(\S++)\s*+\z", 1)
    s = F.when(same(F.regexp_extract(after, r"(?U)^\s*(\S+)", 1), tail), F.regexp_replace(s, r"(?U)(?<!\s)\s++\S++\s*+\z", "")).otherwise(s)
    return F.when(at > 0, F.concat(before, s, after))


def gazetteer(text: Column, lexicon: Sequence[tuple[str, str]]) -> Column:
    """(surface, category) of the lexicon's forms that stand in the text as whole words, then of gentilics in small letters.

    lexicon: (form, category) pairs in order, a table of bounded size that travels in the plan. Each surface counts once.
    """
    cyrillic = "[А-Яа-яЁё]"
    pair = "array<struct<surface:string,category:string>>"
    first: dict[str, str] = {}
    for form, category in lexicon:
        first.setdefault(form, category)
    forms = [F.struct(F.lit(f).alias("surface"), F.lit(c).cast("string").alias("category")) for f, c in first.items()]
    whole = lambda f: text.contains(f["surface"]) & F.regexp_like(text, F.concat(F.lit(f"(?<!{cyrillic})"), _literal(f["surface"]), F.lit(f"(?!{cyrillic})")))
    listed = F.filter(F.array(*forms), whole).cast(pair) if forms else F.array().cast(pair)
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?<!{cyrillic}){cyrillic}[а-яё\\-]+"), F.lit(0)))
    ends = lambda w: w.rlike(f"^[а-яё].*(?:{'|'.join(GENTILICS)})$") & (F.length(w) >= 6)
    known = F.transform(listed, lambda x: x["surface"])
    more = F.filter(words, lambda w: ends(w) & ~w.isin(*NOT_GENTILICS) & ~F.array_contains(known, w))
    return F.concat(listed, F.transform(more, lambda w: F.struct(w.alias("surface"), F.lit("people").alias("category"))).cast(pair))


def without_keys(params: Column, pattern: str) -> Column:
    """A map without the keys that the pattern finds, whose rule the caller gives."""
    return F.map_filter(params, lambda k, _: ~k.rlike(pattern))

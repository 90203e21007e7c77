"""Paragraph text and links of HTML pages, as gold mentions."""

from __future__ import annotations

import bisect
import re
import unicodedata
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.functions import text as T

# What is left out of a page, spaces that count as plain ones, brackets that glue a sign to its
# neighbour, and classes of dates.
DROPPED_TAGS = ("table", "style", "script")
DROPPED_CLASSES = ("infobox", "navbox", "reference", "mw-editsection")
SPACES = "[   -     　﻿]"
GLUE = "()[]{}⟨⟩«»<>"
DATE_CLASSES = ("Q3186692", "Q39911", "Q578", "Q3311614", "Q29964144", "Q14795564", "Q18340514")

#: Characters of html after which a task gives on what it has.
PIECE = 1 << 20
#: Tags without content, and tags whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote center dir div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class _Page(HTMLParser):
    """Collects paragraphs as [text parts, links], a link as [href, text parts]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.paragraphs: list = []
        self.open: list = []  # [tag, dropped, paragraph or None, link or None]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and any(x[0] == "p" for x in self.open):
            self.handle_endtag("p")
        if tag in VOID:
            return
        named = dict(attrs)
        dropped = bool(self.open and self.open[-1][1]) or tag in DROPPED_TAGS or any(x in (named.get("class") or "") for x in DROPPED_CLASSES)
        paragraph, link = (self.open[-1][2], self.open[-1][3]) if self.open else (None, None)
        if not dropped and tag == "p":
            paragraph = [[], []]
            self.paragraphs.append(paragraph)
        if not dropped and tag == "a" and paragraph is not None:
            link = [named.get("href") or "", []]
            paragraph[1].append(link)
        self.open.append([tag, dropped, paragraph, link])

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open and not self.open[-1][1] and self.open[-1][2] is not None:
            self.open[-1][2][0].append(data)
            if self.open[-1][3] is not None:
                self.open[-1][3][1].append(data)


def _plain(parts: list[str]) -> str:
    return re.sub(SPACES, " ", unicodedata.normalize("NFC", "".join(parts)))


def parsed(html: str | None) -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, [(href, surface)]) of every paragraph of a page; boxes, tables, scripts and references are left out."""
    page = _Page()
    page.feed(html or "")
    page.close()
    return [(_plain(p), [(href, _plain(s)) for href, s in links]) for p, links in page.paragraphs]


def glued(text: str, pos: int, surface: str) -> bool:
    """A single sign with a letter, digit, mark or bracket next to it."""
    sticks = lambda c: unicodedata.category(c)[0] in "LNM" or c in GLUE
    end = pos + len(surface)
    return len(surface.strip()) == 1 and ((pos > 0 and sticks(text[pos - 1])) or (end < len(text) and sticks(text[end])))


def mentions(html: str | None) -> list[tuple[int, int, str, str, int, bool]]:
    """(place, token index, surface, href, tokens, glued) of every link with text, in order.

    A link is looked for after the one before it in its paragraph, else from the paragraph's start.
    """
    paragraphs = parsed(html)
    text = "\n".join(p for p, _ in paragraphs)
    gaps = [m.start() for m in re.finditer(r"\s+", text)]
    out, start = [], 0
    for p, links in paragraphs:
        after = start
        for href, surface in links:
            if not surface.strip():
                continue
            at = text.find(surface, after)
            at = at if at >= 0 else text.find(surface, start)
            if at < 0:
                continue
            after = at + len(surface)
            out.append((at, bisect.bisect_left(gaps, at), surface, href, len(surface.split()), glued(text, at, surface)))
        start += len(p) + 1
    return out


def _each(rows: DataFrame, key: str, html: str, of, schema: str) -> DataFrame:
    """key and what `of` says of each page; a page at a time, given on whenever PIECE characters of html are done."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        fields = [x.split() for x in schema.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        for batch in batches:
            of_schema = pa.schema([(key, batch.schema.field(0).type), *[(n, types[k]) for n, k in fields]])
            out, size = [], 0
            for i in range(batch.num_rows):
                h = batch.column(1)[i].as_py()
                out += [(batch.column(0)[i].as_py(), *x) for x in of(h)]
                size += len(h or "")
                if size >= PIECE or (out and i + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), of_schema)] if out else [pa.array([], f.type) for f in of_schema], schema=of_schema)
                    out, size = [], 0

    return rows.select(key, html).mapInArrow(run, f"{key} {kind}, {schema}")


def flattened(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text): a page's paragraphs, one a line; null html has none."""
    return _each(pages, key, html, lambda h: [("\n".join(p for p, _ in parsed(h)),)], "text string")


def found(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, token_index, surface, href, span, glued, title) of the pages' links; title is null outside articles."""
    out = _each(pages, key, html, mentions, "place long, token_index long, surface string, href string, span long, glued boolean")
    return out.withColumn("title", T.link_title(F.col("href")))


def resolved(links: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """Links with canonical title, qid and fate: symbol, nonmain, redlink, no_qid, chrono or gold, the first that holds.

    titles: (title, canonical, qid, classes), a row for every title with a page.
    """
    t = titles.withColumn("known", F.lit(True))
    out = links.join(t, "title", "left")
    fate = F.when(F.col("glued"), "symbol").when(F.col("title").isNull(), "nonmain").when(F.col("known").isNull(), "redlink")
    fate = fate.when(F.coalesce("qid", F.lit("")) == "", "no_qid").when(F.arrays_overlap("classes", F.array(*map(F.lit, DATE_CLASSES))), "chrono").otherwise("gold")
    return out.select(key, "place", "token_index", "surface", "span", "title", "canonical", "qid", fate.alias("fate"))


def counters(rows: DataFrame, key: str) -> DataFrame:
    """How many links of each fate a page has; n_anchors are those of articles."""
    count = lambda f, name: F.count_if(F.col("fate") == f).alias(name)
    named = {"no_qid": "n_no_qid", "redlink": "n_redlink", "chrono": "n_excluded_chrono", "nonmain": "n_excluded_nonmain", "symbol": "n_excluded_symbol", "gold": "n_gold"}
    return rows.groupBy(key).agg(F.count_if(~F.col("fate").isin("symbol", "nonmain")).alias("n_anchors"), *[count(f, n) for f, n in named.items()])

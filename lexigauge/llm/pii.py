"""Personal data in plain and in disguise, with spans in the source text.

Plain identifiers are found in the text as it stands. A transducer then rewrites look-alike characters, spelled
digits and at/dot disguises, keeping for each stretch of its output the stretch of source that it stands for.
Identifiers found in the output that touch a rewritten stretch are mapped back to source characters and added, unless
a span already there covers them; one that reaches beyond a plain span is added beside it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, ship

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Stretches that can hold an address, a card or a phone number: seven characters at least, the first a digit.
REGION = re.compile(r"[0-9][0-9 .()\-]{6,}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's number, end) of plain identifiers, in that order; leftmost and non-overlapping within a kind."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((a, 0, end))
        at = text.find("@", max(at + 1, end))
    for r in REGION.finditer(text):
        s, e = r.span()
        for m in IP.finditer(text, s, e):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text, s, e):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if s and text[s - 1] == "+":
            body = r[0].rstrip(" .()-")
            if len(body) >= 3 and 9 <= sum(map(str.isdigit, body)) <= 15:
                out.append((s - 1, 3, s + len(body)))
    return sorted(out)


# Letters of other scripts that look like Latin ones, in alphabet order of the Latin letters.
LOOKS = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
    "@": "＠﹫", ".": "。．․‧", "-": "‐‑‒–—―−", "+": "＋﹢", " ": "      　",
    "": "­​‌‍‎‏⁠﻿",
}
LIKE = {ord(c): k for k, v in LOOKS.items() for c in v} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
# Digit words in English, French, German and Spanish, from nought to nine.
DIGITS = ("zero oh zéro null cero", "one un une eins uno", "two deux zwei dos", "three trois drei tres", "four quatre vier cuatro", "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve")
SPELLED = {w: str(d) for d, ws in enumerate(DIGITS) for w in ws.split()}
AT, DOT = "at|arroba|ät|chez", "dot|point|punkt|punto"
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
TOKEN = rf"(?:(?:double|triple)[ \t]+)?(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))}|{DOT}|plus|[0-9]+)"
RUN = re.compile(rf"(?<!\w){TOKEN}(?:[ \t,;/-]{{1,3}}{TOKEN}){{5,}}(?!\w)", re.I)
OCTET = rf"(?:[0-9]{{1,3}}|(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))})(?:[ \t-]{{1,3}}(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))})){{0,2}})"
#: An address with its dots spelled, its numbers in digits or in words.
DOTTED = re.compile(rf"(?<!\w){OCTET}(?:[ \t]{{1,3}}(?:{DOT})[ \t]{{1,3}}{OCTET}){{3}}(?!\w)", re.I)
PART = re.compile(rf"(?:(double|triple)[ \t]+)?({'|'.join(sorted(SPELLED, key=len, reverse=True))}|{DOT}|plus|[0-9]+)", re.I)
BRACKETED = re.compile(rf"\s{{0,3}}{OPEN}\s{{0,3}}(?:({AT}|@)|(?:{DOT}|\.))\s{{0,3}}{CLOSE}\s{{0,3}}", re.I)
BARE = re.compile(rf"(?<=[A-Za-z0-9._%+-])[ \t]{{1,3}}(?:{AT})[ \t]{{1,3}}(?=([A-Za-z0-9-]{{1,63}}(?:(?:[ \t]{{1,3}}(?:{DOT})[ \t]{{1,3}}|\.)[A-Za-z0-9-]{{1,63}})+))", re.I)
BARE_DOT = re.compile(rf"[ \t]{{1,3}}(?:{DOT})[ \t]{{1,3}}", re.I)
NAME = re.compile(rf"(?:[A-Za-z0-9_+-]{{1,40}}[ \t]{{1,3}}(?:{DOT})[ \t]{{1,3}}){{1,4}}[A-Za-z0-9_+-]{{1,40}}\Z", re.I)
#: Whether anything is to be rewritten; most texts end here.
ODD = re.compile("[ ­ɐ-\U0010ffff]")
DISGUISED = re.compile(rf"{OPEN}\s{{0,3}}(?:{AT}|@|{DOT}|\.)\s{{0,3}}{CLOSE}|[ \t](?:{DOT})[ \t]", re.I)
THREE = re.compile(rf"(?<!\w)(?:{'|'.join(SPELLED)})[ \t,;/-]{{1,3}}(?:(?:double|triple)[ \t]+)?(?:{'|'.join(SPELLED)}|{DOT}|[0-9]+)[ \t,;/-]{{1,3}}(?:{'|'.join(SPELLED)}|{DOT}|[0-9]+|double|triple)(?!\w)", re.I)


class Rewritten:
    """The transducer's output with its alignment: stretches that stand as they are, and stretches that replace source."""

    def __init__(self, text: str):
        self.text, self.out, self.at, self.src = text, [], [0], []  # src: (start, end, stands as it is)

    def put(self, piece: str, start: int, end: int, same: bool = False):
        if piece or end > start:
            self.out.append(piece)
            self.at.append(self.at[-1] + len(piece))
            self.src.append((start, end, same))

    def back(self, s: int, e: int) -> tuple[int, int] | None:
        """The source span of output [s, e); None if nothing in it was rewritten."""
        i, j = bisect_right(self.at, s) - 1, bisect_right(self.at, e - 1) - 1
        if all(self.src[k][2] for k in range(i, j + 1)):
            return None
        a, _, same = self.src[i]
        start = a + (s - self.at[i]) if same else a
        a, b, same = self.src[j]
        return start, (a + (e - self.at[j]) if same else b)


def _edits(text: str) -> list[tuple[int, int, str]]:
    """Replacements (start, end, new) in order, none overlapping."""
    found = []
    spelled, dotted = THREE.search(text), DISGUISED.search(text)
    if spelled or dotted:
        addresses = list(DOTTED.finditer(text)) if dotted else []
        starts = {m.start() for m in addresses}
        for m in (*(RUN.finditer(text) if spelled else ()), *addresses):
            words = [(p, (p[2] or "").lower()) for p in PART.finditer(text, *m.span())]
            if m.re is RUN and sum(w in SPELLED for _, w in words) < 3:
                continue
            last = m.start()
            for k, (p, w) in enumerate(words):
                apart = p.start() in starts and words[k - 1][1].isdigit()  # a number before an address isn't part of it
                if p.start() > last and k and not apart:
                    found.append((last, p.start(), ""))
                new = SPELLED.get(w) or ("+" if w == "plus" else w if w.isdigit() else ".")
                found.append((p.start(), p.end(), new * {"double": 2, "triple": 3}.get((p[1] or "").lower(), 1)))
                last = p.end()
    if dotted:
        found += [(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(text)]
        for m in BARE.finditer(text):
            dots = list(BARE_DOT.finditer(text, m.start(1), m.end(1)))
            if dots:  # a bare "at" before a plain host name is prose
                found.append((m.start(), m.end(), "@"))
                found += [(d.start(), d.end(), ".") for d in dots]
                if before := NAME.search(text, max(0, m.start() - 200), m.start()):
                    found += [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(text, *before.span())]
        for m in re.finditer(rf"@[A-Za-z0-9-]{{1,63}}((?:[ \t]{{1,3}}(?:{DOT})[ \t]{{1,3}}[A-Za-z0-9-]{{1,63}})+)", text, re.I):
            found += [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(text, m.start(1), m.end(1))]
    if ODD.search(text):
        for m in ODD.finditer(text):
            c = m[0]
            new = LIKE.get(ord(c))
            if new is None and (d := unicodedata.digit(c, None)) is not None:
                new = str(d)
            if new is not None:
                found.append((m.start(), m.end(), new))
    found.sort()
    out, last = [], 0
    for s, e, new in found:
        if s >= last:
            out.append((s, e, new))
            last = e
    return out


def rewrite(text: str) -> Rewritten:
    r, last = Rewritten(text), 0
    for s, e, new in _edits(text):
        r.put(text[last:s], last, s, True)
        r.put(new, s, e)
        last = e
    r.put(text[last:], last, len(text), True)
    return r


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(plain spans, added spans). Look-alikes may hide in what spelling and disguises leave, so rewriting runs twice."""
    base = detect(text)
    if not (ODD.search(text) or DISGUISED.search(text) or THREE.search(text)):
        return base, []
    first = rewrite(text)
    once = "".join(first.out)
    second = rewrite(once)
    twice = "".join(second.out)
    seen = []
    for level in ([first], [second, first]) if second.src and not all(x[2] for x in second.src) else ([first],):
        for s, kind, e in detect(once if len(level) == 1 else twice):
            span, touched = (s, e), False
            for r in level:
                mapped = r.back(*span)
                touched |= mapped is not None
                if mapped is None:
                    i = bisect_right(r.at, span[0]) - 1
                    shift = r.src[i][0] - r.at[i]
                    mapped = (span[0] + shift, span[1] + shift)
                span = mapped
            if touched:
                seen.append((span[0], kind, span[1]))
    added, taken = [], [(s, e) for s, _, e in base]
    # the longest first, so a shorter one that it covers adds nothing
    for s, kind, e in sorted(seen, key=lambda x: (x[0] - x[2], x)):
        if not any(a <= s and e <= b for a, b in taken):
            added.append((s, kind, e))
            taken.append((s, e))
    return base, sorted(added)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches):
    import pyarrow as pa

    for batch in batches:
        out = [[] for _ in range(8)]
        for text in column(batch, "text"):
            base, added = find(text.decode())
            n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
            for o, x in zip(out, (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added), joined(added))):
                o.append(x)
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(o, t) for o, t in zip(out, kinds))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "added"])


def spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts of plain spans by kind, base_sha256 over them, all spans, and those that rewriting added.

    A span is kind:start:end in code points of the source, end exclusive. A null text is empty. No span covers
    an added one; an added span may reach beyond a plain one that it overlaps, and both stay.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, added string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, schema)

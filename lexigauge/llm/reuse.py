"""BPE by reuse of content-defined chunks: a chunk that texts share is encoded once, joins are encoded again till they agree.

A rolling hash over 32 bytes cuts texts where their content says, so copied passages give equal chunks wherever they
stand. Chunks found twice or more are encoded once in all. A text is put together from their cores and from windows
that reach from within one shared chunk over whatever lies between into the next; a window counts only if its first word is
the chunk's own and it has a word's start, and then the same words, where the next core starts. Else that chunk is given
up and the window grows over it, to the whole text at last.

Why that is exact: words are matched from left to right by a pattern without look-behind, so from a common start on
equal text gives equal words, but for the last few characters before an end; NFC changes nothing across a character that
neither combines nor is combined with; added tokens are shorter than the margins. White space parts words in any case.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, array_slices, column, drop, keep, mix, ship, spots, tidy

#: Bytes of a chunk: least, most, and a cut at one place in 2^CUT_BITS after the least.
LEAST, MOST, CUT_BITS, WINDOW = 128, 2048, 7, 32
#: Bits of the filter that tells shared chunks; bytes of text of a task, and of one call of the tokenizer.
FILTER_BITS, TASK_BYTES, CALL_BYTES = 1 << 27, 16 << 20, 1 << 18
#: Parts between blanks that a task remembers at a time, and the longest of them in characters.
MEMO, LONG_PART = 300_000, 200
#: A letter and a stop or comma behind it are two words in any case (U+0130 isn't among them: its small form ends in a mark).
STOPS = re.compile("(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u045f])(?=[.,;:!?])")
#: Letters that NFC leaves alone, of which each has one small form: a part of these alone is one word.
WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u045f]+")
END = "\x01"
#: Characters that a core stays away from its chunk's ends.
MARGIN = 16


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass
class Codec:
    tokenizer: object
    tokens: list
    numbers: list
    margin: int
    plain: bool
    mark: tuple | None  # an added token and its id
    wide: bool  # ids or places need more than 16 bits
    ranks: tuple | None = None  # a rank encoder, the ids of its ranks, and which of them end a word
    known: dict = field(default_factory=dict)

    def ids(self, text: str) -> list[int]:
        """The ids of a text. White space parts words in any case, so what stands between blanks is encoded once while it's remembered."""
        out, known = [], self.known
        for piece in _pieces(text):
            parts = STOPS.sub(" ", piece).replace("\n", " ").split(" ")
            if len(known) > MEMO:
                known.clear()
            new = list(set(parts).difference(known))
            self._learn(new)
            out += chain.from_iterable(map(known.__getitem__, parts))
            for p in new:
                if len(p) > LONG_PART:
                    del known[p]
        return out

    def _learn(self, parts: list[str]) -> None:
        """The ids of parts, read off one text of all of them with an added token in between, which parts text before anything else."""
        if self.ranks and (plain := [p for p in parts if WORD.fullmatch(p)]):
            encoder, ids, ends = self.ranks
            found = encoder.encode_to_numpy(END.join(plain).lower() + END)
            at = (np.flatnonzero(ends[found]) + 1).tolist()
            found = ids[found].tolist()
            self.known |= {p: found[a:b] for p, a, b in zip(plain, [0, *at], at)}
            parts = [p for p in parts if p not in self.known]
        apart = [p for p in parts if self.mark is None or self.mark[0] in p]
        self.known |= {p: e.ids for p, e in zip(apart, self.tokenizer.encode_batch_fast(apart, add_special_tokens=False))}
        if len(apart) == len(parts):
            return
        text, mark = self.mark
        parts = [p for p in parts if text not in p]
        ids = next(iter(self.tokenizer.encode_batch_fast([text.join(parts)], add_special_tokens=False))).ids
        at = [*np.flatnonzero(np.array(ids) == mark).tolist(), len(ids)]
        self.known |= {p: ids[a + 1 : b] for p, a, b in zip(parts, [-1, *at], at)}

    def digest(self, ids) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text)."""
        text = " ".join(map(self.tokens.__getitem__, ids)) if self.plain else self.tokenizer.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(" ".join(map(self.numbers.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _ranked(model: dict):
    """A rank encoder of the same merges for plain words: the end of a word is a byte, with which the last letter merges first.

    A merge by rank of what it makes is the merge of its pair: what stands between two borders that no merge has crossed was
    merged as it is alone, so a string has one pair.
    """
    import tiktoken

    suffix = model.get("end_of_word_suffix")
    if not suffix or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
        return None
    free = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in free} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in free)}
    letter, end = {b: c for c, b in shown.items()}, END.encode()
    raw = lambda t: bytes(shown[c] for c in t.removesuffix(suffix)) + (end if t.endswith(suffix) else b"")
    strings = {bytes([b]): letter[b] for b in range(256)} | {bytes([b]) + end: letter[b] + suffix for b in range(256) if bytes([b]) != end}
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if letter[end[0]] not in a + b:
            strings.setdefault(raw(a + b), a + b)
    ids = np.array([model["vocab"].get(t, -1) for t in strings.values()], np.int64)
    ends = np.array([t.endswith(suffix) for t in strings.values()])
    return tiktoken.Encoding("words", pat_str=f"[^{END}]*{END}", mergeable_ranks={t: i for i, t in enumerate(strings)}, special_tokens={}), ids, ends


@functools.lru_cache(2)
def codec(spec: bytes) -> Codec:
    """The tokenizer of a file. Refuses what the reuse of chunks isn't exact for."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    told = json.loads(spec)
    flat = lambda x, key: [y for p in x.get(key, []) for y in flat(p, key)] if x and x["type"] == "Sequence" else [x] if x else []
    norms, cuts, added = flat(told["normalizer"], "normalizers"), flat(told["pre_tokenizer"], "pretokenizers"), told.get("added_tokens", [])
    odd = [n["type"] for n in norms if n["type"] not in ("NFC", "Lowercase") and (n["type"] != "Replace" or n["pattern"] != {"Regex": r"\s+"} or n["content"] != " ")]
    if [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"] or "(?<" in str(cuts[0]["pattern"]):
        odd.append("pre_tokenizer")
    odd += [t["content"] for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) or t["content"].split() != [t["content"]]]
    if odd or told["model"]["type"] != "BPE":
        raise ValueError(f"chunks can't be joined exactly under {odd or told['model']['type']}")
    t = Tokenizer.from_str(spec.decode())
    t.no_truncation()
    t.no_padding()
    n = max(t.get_vocab(True).values()) + 1
    return Codec(t, [t.id_to_token(i) for i in range(n)], [str(i) for i in range(n)], max([MARGIN, *(len(x["content"]) + 1 for x in added)]), told.get("decoder") is None, (added[0]["content"], added[0]["id"]) if added else None, max(n, MOST + WINDOW) > 1 << 16, _ranked(told["model"]))


_BYTE = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def chunks(texts: list[bytes]) -> list[list[int]]:
    """Where each text's chunks end: the last one ends with the text, an empty text has none."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, power = _BYTE[data], np.uint32(0x9E3779B1)
    with np.errstate(over="ignore"):
        for w in (1, 2, 4, 8, 16):
            h = h[:-w] * power + h[w:] if len(h) > w else h[:0]
            power = np.uint32(power * power)
    hit = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + WINDOW
    hit = hit[hit < len(data)]
    hit = hit[data[hit] & 0xC0 != 0x80].tolist()  # only where a character starts
    out, start = [], 0
    for t in texts:
        ends, at, end = [], start, start + len(t)
        while end - at > LEAST:
            i = bisect_left(hit, at + LEAST)
            cut = hit[i] if i < len(hit) else end
            if cut > at + MOST:
                cut = at + MOST
                while cut < end and data[cut] & 0xC0 == 0x80:
                    cut += 1
            if cut >= end:
                break
            ends.append(cut - start)
            at = cut
        out.append([*ends, len(t)] if t else [])
        start = end
    return out


def keys(text: bytes, ends: list[int]) -> list[bytes]:
    """The 128-bit hashes of a text's chunks."""
    import xxhash

    return [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *ends], ends)]


def spot(key: bytes) -> int:
    return int.from_bytes(key[:8], "little")


def _pieces(text: str) -> list[str]:
    """A text cut at blanks, where words end in any case, into pieces that a call of the tokenizer holds easily."""
    out, at = [], 0
    while len(text) - at > CALL_BYTES:
        cut = text.rfind(" ", at, at + CALL_BYTES)
        cut = text.find(" ", at) if cut <= at else cut
        if cut <= at:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def words(code: Codec, texts: list[str]):
    """(start, end, ids) of the words of each text, in characters."""
    for i in range(0, len(texts), 256):
        for e in code.tokenizer.encode_batch(texts[i : i + 256], add_special_tokens=False):
            out, now = [], None
            for word, (a, b), x in zip(e.word_ids, e.offsets, e.ids):
                if word != now or now is None:
                    out.append([a, b, [x]])
                    now = word
                else:
                    out[-1][1] = b
                    out[-1][2].append(x)
            yield out


def calm(text: str) -> bool:
    """Whether a character neither combines with the one before nor is combined with it: NFC acts on both sides apart."""
    return any(c < "\x80" or not (unicodedata.category(c).startswith("M") or "ᅠ" <= c <= "ᇿ" or unicodedata.combining(c)) for c in text)


CORE = "core binary, first int, last int, upto int, head binary, tail binary"


def core(text: str, found: list, margin: int = MARGIN):
    """What of a chunk's words holds in any text, or None: ids, where they start and end, the end of a window into them, and the words to compare.

    found: the words of the chunk alone. A window from before ends at `upto`; one to what follows starts at `last`.
    """
    n = len(text)
    i = next((i for i, w in enumerate(found) if w[0] >= margin and calm(text[: w[0]])), None)
    k = next((k for k in range(len(found) - 1, -1, -1) if found[k][1] <= n - margin and calm(text[found[k][0]]) and calm(text[found[k][1] :])), None)
    if i is None or k is None or i >= k:
        return None
    first, last = found[i][0], found[k][0]
    j = next((j for j in range(i, len(found)) if found[j][1] >= first + 2 * margin and calm(text[first + 1 : found[j][1]])), None)
    if j is None:
        return None
    flat = lambda ws: [x for a, b, ids in ws for x in (a, b, len(ids), *ids)]
    upto = found[j][1]
    return [x for w in found[i:k] for x in w[2]], first, last, upto, flat([w for w in found[i:j] if w[1] <= upto - margin]), flat([found[k]])


def packed(numbers, wide: bool) -> bytes:
    return np.array(numbers, "<u4" if wide else "<u2").tobytes()


def _read(flat) -> list:
    out, i = [], 0
    while i < len(flat):
        n = flat[i + 2]
        out.append([flat[i], flat[i + 1], list(flat[i + 3 : i + 3 + n])])
        i += 3 + n
    return out


def joined(code: Codec, texts: list[bytes], cores: dict[bytes, tuple]) -> list[list[int]]:
    """The ids of texts from the cores of their shared chunks and windows between them, which grow until they agree."""
    shown, place = [t.decode("utf-8", "replace") for t in texts], []
    for text, ends in zip(texts, chunks(texts)):
        chars, at, a, own = 0, 0, 0, []  # cores by their chunk's place in characters
        for key, b in zip(keys(text, ends), ends):
            if key in cores:
                chars, at = chars + len(text[at:a].decode("utf-8", "replace")), a
                own.append((chars, cores[key]))
            a = b
        place.append(own)
    done, ids = {}, [None] * len(texts)
    todo = list(range(len(texts)))
    while todo:
        asked = {}
        for d in todo:
            for i, (a, b) in enumerate(_windows(place[d], len(shown[d]))):
                if (d, a, b) not in done:
                    first = place[d][i][0] + place[d][i][1][1] - a if i < len(place[d]) else None
                    asked[d, a, b] = (shown[d][a:b], i > 0, first)
        done |= zip(asked, _read_windows(code, list(asked.values())))
        again = []
        for d in todo:
            bad = _disagreed(place[d], len(shown[d]), lambda a, b: done[d, a, b])
            if bad is None:
                ids[d] = _together(place[d], len(shown[d]), lambda a, b: done.pop((d, a, b)))
            else:
                del place[d][bad]
                again.append(d)
        todo = again
    return ids


def _blank(text: str, at: int, end: int) -> int:
    """The first blank or line feed from a place on, or the end."""
    found = [x for x in (text.find(" ", at, end), text.find("\n", at, end)) if x >= 0]
    return min(found, default=end)


def _read_windows(code, windows):
    """The words of windows (text, whether its start must agree, where a core starts in it or None).

    Places matter at a window's ends only: what lies between a blank behind its start and one before the core is one entry.
    """
    parts, ends = [], []
    for text, left, first in windows:
        n = len(text)
        a = _blank(text, min(n, 4 * code.margin), n) if left else 0
        b = n if first is None else max(text.rfind(" ", 0, max(0, first - 2 * code.margin)), text.rfind("\n", 0, max(0, first - 2 * code.margin)))
        a, b = (0, 0) if b < a else (a, b)  # one piece: read all of it
        parts.append((a, b))
        ends += [text[:a], text[b:] if b < n else ""]
    read = words(code, ends)
    for (text, _, _), (a, b) in zip(windows, parts):
        start, end = next(read), next(read)
        middle = [[a, b, code.ids(text[a:b])]] if b > a else []
        yield start + middle + [[x + b, y + b, ids] for x, y, ids in end]


def _windows(place, n):
    """(first, past the last) character of the windows before, between and after the cores."""
    starts = [0, *(at + c[2] for at, c in place)]
    return list(zip(starts, [*(at + c[3] for at, c in place), n]))


def _disagreed(place, n, window):
    """A chunk whose words a window doesn't agree with, or None."""
    for i, (a, b) in enumerate(_windows(place, n)):
        ws = window(a, b)
        if i:
            at, c = place[i - 1]
            if not ws or [ws[0][0] + a - at, ws[0][1] + a - at, ws[0][2]] != _read(c[5])[0]:
                return i - 1
        if i < len(place):
            at, c = place[i]
            k = bisect_left(ws, at + c[1] - a, key=lambda w: w[0])
            head = _read(c[4])
            if k == len(ws) or ws[k][0] + a - at != c[1] or [[w[0] + a - at, w[1] + a - at, w[2]] for w in ws[k : k + len(head)]] != head or (k and ws[k - 1][1] > ws[k][0]):
                return i
    return None


def _together(place, n, window):
    out = []
    for i, (a, b) in enumerate(_windows(place, n)):
        stop = place[i][0] + place[i][1][1] - a if i < len(place) else n
        for w in window(a, b):
            if w[0] >= stop:
                break
            out += w[2]
        if i < len(place):
            out += place[i][1][0]
    return out


def _counted(batches):
    """(spot, times, bytes) of the chunks of a slice of texts."""
    import pyarrow as pa

    for batch in batches:
        texts = column(batch, "text")
        for a, b in array_slices(batch.column("text")):
            part = texts[a:b]
            at = np.array([spot(k) for t, ends in zip(part, chunks(part)) for k in keys(t, ends)], np.uint64).view(np.int64)
            of, n = np.unique(at, return_counts=True)
            size = np.zeros(len(of), np.int64)
            if len(of):
                size[0] = sum(map(len, part))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(n, pa.int64()), pa.array(size)], ["spot", "n", "bytes"])


def _shared(filter_bits, bits):
    of = np.frombuffer(filter_bits, np.uint8)

    def has(key: bytes) -> bool:
        at = spot(key) & (bits - 1)
        return bool(of[at >> 3] >> (at & 7) & 1)

    return has


def _asked(told, bits):
    """(bucket, key, text) of shared chunks, once a slice and bucket; the text only once a task."""

    def run(batches):
        import pyarrow as pa

        has, sent = _shared(told.value, bits), set()
        for batch in batches:
            texts, bucket = column(batch, "text"), batch.column("bucket").to_pylist()
            for a, b in array_slices(batch.column("text")):
                out = {}
                for t, ends, k in zip(texts[a:b], chunks(texts[a:b]), bucket[a:b]):
                    at = 0
                    for key, end in zip(keys(t, ends), ends):
                        if has(key) and (k, key) not in out:
                            out[k, key] = None if key in sent else t[at:end]
                            sent.add(key)
                        at = end
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([k for _, k in out], pa.binary()), pa.array(list(out.values()), pa.binary())], ["bucket", "key", "text"])

    return run


def _cores(spec):
    def run(batches):
        import pyarrow as pa

        code = codec(spec.value)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            for a in range(0, len(raw), 512):
                texts = [x.decode("utf-8", "replace") for x in raw[a : a + 512]]
                found = [core(t, ws, code.margin) for t, ws in zip(texts, words(code, texts))]
                found = [f and [packed(f[0], code.wide), *f[1:4], *(packed(x, code.wide) for x in f[4:])] for f in found]
                cols = list(zip(*[f or [None] * 6 for f in found]))
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, 512), *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["key", "core", "first", "last", "upto", "head", "tail"])

    return run


RESULT = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _told(doc, results, more=()):
    import pyarrow as pa

    n, ids, text = zip(*results) if results else ((), (), ())
    return [doc, *more, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]


def _alone(spec, told, bits):
    """Results of texts without a shared chunk; the others as they are."""

    def run(batches):
        import pyarrow as pa

        code, has = codec(spec.value), _shared(told.value, bits)
        for batch in batches:
            texts = column(batch, "text")
            for a, b in array_slices(batch.column("text"), SLICE_BYTES // 2):
                part = texts[a:b]
                waits = [any(map(has, keys(t, ends))) for t, ends in zip(part, chunks(part))]
                results = [(None, None, None) if w else code.digest(code.ids(t.decode("utf-8", "replace"))) for t, w in zip(part, waits)]
                more = [batch.column("bucket").slice(a, b - a), pa.array([t if w else None for t, w in zip(part, waits)], pa.binary())]
                yield pa.RecordBatch.from_arrays(_told(batch.column("doc_id").slice(a, b - a), results, more), ["doc_id", "bucket", "text", *RESULT])

    return run


def _assembled(spec):
    def run(rows, shared):
        import pyarrow as pa

        code = codec(spec.value)
        cores = dict(zip(shared["key"].to_pylist(), zip(*(shared[c].to_pylist() for c in ("core", "first", "last", "upto", "head", "tail")))))
        plain = lambda x: np.frombuffer(x, "<u4" if code.wide else "<u2").tolist()
        cores = {k: (plain(c[0]), *c[1:4], plain(c[4]), plain(c[5])) for k, c in cores.items() if c[0] is not None}
        texts, results = rows["text"].to_pylist(), list(zip(*(rows[c].to_pylist() for c in RESULT)))
        size, held, known = 0, [], {}

        def put():
            for t, ids in zip(held, joined(code, held, cores)):
                known[hashlib.sha256(t).digest()] = code.digest(ids)
            held.clear()

        seen = set()
        for t in texts:
            if t is None or (mark := hashlib.sha256(t).digest()) in seen:
                continue
            seen.add(mark)
            held.append(t)
            size += len(t)
            if size > CALL_BYTES * 4:
                put()
                size = 0
        put()
        results = [r if t is None else known[hashlib.sha256(t).digest()] for t, r in zip(texts, results)]
        return pa.table(_told(rows["doc_id"], results), ["doc_id", *RESULT])

    return run


def digests(docs: DataFrame, vocab: str | None = None, bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, as the tokenizers library gives them.

    A null text is empty: no ids, hashes of nothing. Repeated rows give a row each; other columns aren't read; an empty
    table gives no rows. Texts of any length: long ones are encoded in pieces cut at blanks, one without a blank whole.

    Broadcast: the vocabulary file and a filter of `bits` bits (16 MB), whatever the number of documents. It may take a
    chunk for shared that isn't; that costs time only. Texts with shared chunks go through one shuffle, by a hash of
    row and text; shared chunks' ids go once to each task that wants them, so a chunk of all documents has a row a task.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocab or default_vocab(), "rb") as f:
        raw = f.read()
    codec(raw)
    spec = spark.sparkContext.broadcast(raw)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = keep(own.select("text").mapInArrow(_counted, "spot long, n long, bytes long"))
    size = counted.agg(F.sum("bytes")).first()[0] or 0
    twice = counted.groupBy("spot").agg(F.sum("n").alias("n")).where("n > 1")
    told = spark.sparkContext.broadcast(spots(twice, F.col("spot").bitwiseAND(F.lit(bits - 1)), bits).tobytes())
    drop(counted)
    tidy(spark)
    buckets = max(1, -(-size // TASK_BYTES))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
    asked = keep(own.select("text", "bucket").mapInArrow(_asked(told, bits), "bucket long, key binary, text binary"))
    texts = asked.where("text is not null").groupBy("key").agg(F.first("text").alias("text"))
    cores = texts.mapInArrow(_cores(spec), f"key binary, {CORE}")
    wanted = asked.select("bucket", "key").distinct().join(cores, "key")
    rows = own.mapInArrow(_alone(spec, told, bits), "doc_id long, bucket long, text binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_assembled(spec), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

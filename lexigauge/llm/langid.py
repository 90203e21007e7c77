"""Language of every word by a linear-chain conditional random field, and of a text by its words.

Words are scored by hashed features (prefixes, suffixes, character n-grams, membership in learned word lists), labels
by learned transitions. Training maximises the conditional likelihood of sequences spliced from texts of several
languages, so switches inside a text are seen; marginals come from the forward-backward recursions.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, column, quoted, ship, slices

#: Bounds of the training sample: texts per language, texts in all (each language keeps one at least), spliced sequences, their words.
TRAIN_TEXTS, TRAIN_ALL, SEQUENCES, LENGTH = 150, 9600, 1600, 36
FEATURES, LEXICON, EPOCHS, RATE, L2 = 1 << 16, 300, 60, 0.15, 1e-4
#: Word types a worker remembers between texts.
REMEMBERED = 200_000

UNKNOWN = "und"


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _word(astral: bool) -> re.Pattern:
    """By Unicode category: letters, then letters and marks. A class within the first plane is a table, so it is kept apart."""
    kinds = {"L": [], "M": []}
    for i in range(sys.maxunicode + 1 if astral else 1 << 16):
        if (k := unicodedata.category(chr(i))[0]) in kinds:
            runs = kinds[k]
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    letters, marks = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in kinds[k]) for k in "LM")
    return re.compile(f"[{letters}][{letters}{marks}]*")


def words(text: str) -> list[str]:
    """Runs of letters and combining marks that start with a letter, lower-cased."""
    text = text.lower()
    return _word(ASTRAL.search(text) is not None).findall(text)


def _hash(cols, salt: int) -> np.ndarray:
    h = np.full(len(cols[0]), salt, np.uint64)
    with np.errstate(over="ignore"):
        for c in cols:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return (h % np.uint64(FEATURES)).astype(np.int64)


def features(kinds: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs: bias, affixes up to four characters, edged two- and three-character n-grams, lists that hold the word."""
    n = np.array([len(w) for w in kinds], np.int64)
    code = np.frombuffer(("^" + "$^".join(kinds) + "$").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    start = np.cumsum(n + 2) - (n + 2)
    ids, who = [np.zeros(len(kinds), np.int64)], [np.arange(len(kinds))]
    owner = np.repeat(np.arange(len(kinds)), n + 2)
    for k in (2, 3):
        at = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])
        ids.append(_hash([code[at + i] for i in range(k)], k))
        who.append(owner[at])
    for k in range(1, 5):
        w = np.flatnonzero(n >= k)
        ids += [_hash([code[start[w] + 1 + i] for i in range(k)], 10 + k), _hash([code[start[w] + 1 + n[w] - k + i] for i in range(k)], 20 + k)]
        who += [w, w]
    listed = [(i, j) for i, x in enumerate(kinds) if x in lexicon for j in lexicon[x]]
    if listed:
        i, j = np.array(listed).T
        ids.append(_hash([j.astype(np.uint64)], 30))
        who.append(i)
    return np.concatenate(ids), np.concatenate(who)


class Types:
    """Emission scores of word types, remembered up to a bound."""

    def __init__(self, weights, lexicon):
        self.weights, self.lexicon, self.seen, self.scores = weights, lexicon, {}, np.zeros((0, weights.shape[1]), np.float32)

    def of(self, flat: list[str]) -> np.ndarray:
        """A row of self.scores for each word."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.scores = {}, self.scores[:0]
        new = [w for w in dict.fromkeys(flat) if w not in self.seen]
        for a in range(0, len(new), 10_000):
            part = new[a : a + 10_000]
            ids, who = features(part, self.lexicon)
            found = np.stack([np.bincount(who, weights=self.weights[ids, j], minlength=len(part)) for j in range(self.weights.shape[1])], 1)
            self.seen.update(zip(part, range(len(self.scores), len(self.scores) + len(part))))
            self.scores = np.concatenate([self.scores, found.astype(np.float32)])
        return np.fromiter(map(self.seen.__getitem__, flat), np.int64, len(flat))


def marginals(emit: np.ndarray, start: np.ndarray, size: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: np.ndarray | None = None):
    """Posterior label probabilities of every word of many sequences, side by side; also each one's log normaliser.

    emit: scores by word, sequences one after another; sizes are in falling order and at least 1. Expected
    transitions are added to pairs, if given.
    """
    k = emit.shape[1]
    top = emit.max(1, keepdims=True)
    e = np.exp(emit - top)
    m = np.exp(trans - trans.max())
    alpha = np.empty((len(e), k), np.float32)
    log_z = np.bincount(np.repeat(np.arange(len(size)), size), weights=top[:, 0], minlength=len(size)) + (size - 1) * trans.max()
    steps = int(size[0]) if len(size) else 0
    active = len(size) - np.searchsorted(size[::-1], np.arange(steps), "right")
    a = e[start] * np.exp(first)
    for t in range(steps):
        n = active[t]
        at = start[:n] + t
        if t:
            a = (a[:n] @ m) * e[at]
        z = a.sum(1, keepdims=True)
        a = a / z
        log_z[:n] += np.log(z[:, 0])
        alpha[at] = a
    beta = np.ones((0, k))
    post = alpha
    for t in range(steps - 1, -1, -1):
        n = active[t]
        if n > len(beta):
            beta = np.concatenate([beta, np.ones((n - len(beta), k))])
        at = start[:n] + t
        p = alpha[at] * beta
        p /= p.sum(1, keepdims=True)
        if t:
            ahead = e[at] * beta
            if pairs is not None:
                both = alpha[at - 1][:, :, None] * m[None] * ahead[:, None, :]
                pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
            b = ahead @ m.T
            beta = b / b.sum(1, keepdims=True)
        post[at] = p
    return post, log_z


def train(texts: list[tuple[str, str]], epochs: int = EPOCHS) -> dict | None:
    """A field from (language, text) rows; None without any word."""
    by: dict[str, list[list[str]]] = {}
    for lang, text in texts:
        if w := words(text):
            by.setdefault(lang, []).append(w)
    langs = sorted(by)
    if not langs:
        return None
    k, rng = len(langs), np.random.default_rng(20240229)
    lists: dict[str, list[int]] = {}
    for j, lang in enumerate(langs):
        count: dict[str, int] = {}
        for w in by[lang]:
            for x in w:
                count[x] = count.get(x, 0) + 1
        for x in sorted(count, key=lambda x: (-count[x], x))[:LEXICON]:
            lists.setdefault(x, []).append(j)
    lexicon = {w: tuple(js) for w, js in lists.items()}
    flat: list[str] = []
    gold: list[int] = []
    for _ in range(SEQUENCES):
        cuts = np.sort(rng.choice(np.arange(4, LENGTH - 3), rng.integers(0, 3), replace=False))
        for n in np.diff([0, *cuts, LENGTH]):
            j = int(rng.integers(k))
            got: list[str] = []
            while len(got) < n:
                w = by[langs[j]][int(rng.integers(len(by[langs[j]])))]
                at = int(rng.integers(max(1, len(w) - n + 1)))
                got += w[at : at + n - len(got)]
            flat += got
            gold += [j] * int(n)
    kinds: dict[str, int] = {}
    tok = np.fromiter((kinds.setdefault(w, len(kinds)) for w in flat), np.int64, len(flat))
    # a third of the training words hide their lists, so affixes and n-grams carry unseen words
    ids, owner = features(list(kinds), {x: lexicon[x] for i, x in enumerate(kinds) if i % 3 and x in lexicon})
    y = np.array(gold)
    start, size = np.arange(SEQUENCES) * LENGTH, np.full(SEQUENCES, LENGTH)
    w, trans, first = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    squares = [np.full(x.shape, 1e-8) for x in (w, trans, first)]
    hot = np.eye(k)[y]
    inner = np.arange(len(y)) % LENGTH != LENGTH - 1
    left = np.flatnonzero(inner)
    seen_trans = np.zeros((k, k))
    np.add.at(seen_trans, (y[left], y[left + 1]), 1)
    for _ in range(epochs):
        scores = np.stack([np.bincount(owner, weights=w[ids, j], minlength=len(kinds)) for j in range(k)], 1)
        pair = np.zeros((k, k))
        post, _ = marginals(scores[tok], start, size, trans, first, pair)
        post = post.astype(np.float64)
        diff = np.zeros((len(kinds), k))
        for j in range(k):
            diff[:, j] = np.bincount(tok, weights=hot[:, j] - post[:, j], minlength=len(kinds))
        grad_w = np.stack([np.bincount(ids, weights=diff[owner, j], minlength=FEATURES) for j in range(k)], 1)
        grads = (grad_w - L2 * len(y) * w, seen_trans - pair - L2 * len(y) * trans, (hot - post)[start].sum(0) - L2 * len(y) * first)
        for x, g, s in zip((w, trans, first), grads, squares):
            s += g * g
            x += RATE * g / np.sqrt(s)
    return {"langs": langs, "weights": w.astype(np.float32), "trans": trans, "first": first, "lexicon": lexicon}


def label(texts: list[str], types: Types, model: dict) -> list[np.ndarray]:
    """Marginals (words by languages) of each text, as words() splits it."""
    split = [words(t) for t in texts]
    size = np.array([len(w) for w in split], np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    out = [np.zeros((0, len(model["langs"])), np.float32)] * len(texts)
    if len(order):
        at = types.of([w for i in order for w in split[i]])
        n = size[order]
        start = np.cumsum(n) - n
        post, _ = marginals(types.scores[at], start, n, model["trans"], model["first"])
        for i, s, m in zip(order, start, n):
            out[i] = post[s : s + m]
    return out


def _predict(model):
    def run(batches):
        import pyarrow as pa

        m = model.value
        types = Types(m["weights"], m["lexicon"]) if m else None
        for batch in batches:
            texts = column(batch, "text")
            lang, score, n_words, second, switches = [], [], [], [], []
            for a, b in slices(texts, SLICE_BYTES // 4):
                part = [t.decode() for t in texts[a:b]]
                for p in label(part, types, m) if m else [np.zeros((0, 1))] * len(part):
                    n = len(p)
                    total = p.sum(0, dtype=np.float64)
                    o = np.argsort(-total, kind="stable")
                    best = p.argmax(1) if n else p
                    lang.append(m["langs"][o[0]] if n else UNKNOWN)
                    score.append(min(1.0, float(total[o[0]]) / n) if n else 0.0)
                    second.append(m["langs"][o[1]] if n and len(o) > 1 else None)
                    n_words.append(n)
                    switches.append(int((best[1:] != best[:-1]).sum()) if n else 0)
            cols = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n_words, pa.int64()), pa.array(second, pa.string()), pa.array(switches, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], ["row", "lang_pred", "score", "n_words", "second", "n_switches"])

    return run


def sample(docs: DataFrame, folds: int, test_fold: int, per_language: int = TRAIN_TEXTS) -> list[tuple[str, str]]:
    """At most per_language labelled training texts of each language, the least by hash; fewer of each if they would be more than TRAIN_ALL, but one."""
    d = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string"), F.col("text").cast("string"))
    held = F.coalesce(F.crc32(F.col("id").cast("binary")) % folds == test_fold, F.lit(False))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held)
    many = d.select("lang").distinct().count()
    per_language = max(1, min(per_language, TRAIN_ALL // max(1, many)))
    # the limit by rank is applied in every task before rows are shuffled
    w = Window.partitionBy("lang").orderBy(F.xxhash64("id"), F.xxhash64("text"))
    keys = d.select("id", "lang", "text", F.row_number().over(w).alias("k")).where(F.col("k") <= per_language)
    return sorted((r["lang"], r["text"]) for r in keys.select("lang", "text").collect())


def predict(docs: DataFrame, folds: int = 3, test_fold: int = 1, learn_from: DataFrame | None = None) -> DataFrame:
    """docs with held_out, lang_pred, score, n_words, second and n_switches after its own columns (which a clash hides).

    lang_pred is a language seen in training, or `und` with score 0 for a text that is null or has no letter; score
    is the mean probability of lang_pred over the words. Learns from a bounded sample (see sample()) of rows with a
    language whose crc32(doc_id as text) mod folds isn't test_fold; with none, everything is `und`.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(sample(docs if learn_from is None else learn_from, folds, test_fold)))
    mine = ["held_out", "lang_pred", "score", "n_words", "second", "n_switches"]
    own = [c for c in docs.columns if c not in mine]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == test_fold, F.lit(False))
    row = F.struct(*[quoted(c) for c in own], held.alias("held_out"))
    rows = docs.select(F.col("text").cast("string").alias("text"), row.alias("row"))
    schema = T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double").add("n_words", "long").add("second", "string").add("n_switches", "long")
    out = rows.mapInArrow(_predict(model), schema)
    return out.select("row.*", "lang_pred", "score", "n_words", "second", "n_switches")

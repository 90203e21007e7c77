"""Rare words as units of their own, against brute force: classes, class bigrams, scores, and what the model sums to."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexigauge.llm import brown


def settled(monkeypatch):
    """What score() learns: rare words' counts and classes, class bigrams, and the model that is sent."""
    held, settle, scored = {}, brown.settle, brown._scored
    monkeypatch.setattr(brown, "PARTS", 1)  # fewer rounds

    def seen_settle(*args):
        held["rare"], held["g"] = settle(*args)
        held["classes"] = {r["word"]: r["k"] for r in held["rare"].collect()}
        return held["rare"], held["g"]

    def seen_scored(words, model):
        held["words"], held["model"] = words.value, model.value
        return scored(words, model)

    monkeypatch.setattr(brown, "settle", seen_settle)
    monkeypatch.setattr(brown, "_scored", seen_scored)
    return held


def test_rare_words_of_one_ending_get_classes_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(brown, "UNIT_SHARE", 0.02)
    monkeypatch.setattr(brown, "BLOCK_TOKENS", 500)
    held, rng = settled(monkeypatch), random.Random(4)
    kinds = {"left": [f"l{i}xyz" for i in range(150)], "right": [f"r{i}xyz" for i in range(150)]}
    texts = []
    for i in range(400):
        kind = rng.choice(["left", "right"])
        texts.append((i, " ".join(f"{kind} {rng.choice(kinds[kind])} {kind}side" for _ in range(6))))
    brown.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).count()
    ends = {zlib.crc32(b"xyz") % brown.ENDINGS}
    assert {brown.ending(w.encode()) for k in kinds.values() for w in k} == ends  # one unit by their ending
    of = {k: Counter(held["classes"][w] for w in v if w in held["classes"]) for k, v in kinds.items()}
    assert sum(of["left"].values()) > 140 and sum(of["right"].values()) > 140
    assert sum((of["left"] & of["right"]).values()) <= 15  # of 150 that would share a class with their ending's unit


@pytest.mark.parametrize("core_share", [0.0015, 2e-6])
def test_scores_by_hand(spark, monkeypatch, core_share):
    monkeypatch.setattr(brown, "UNIT_SHARE", 0.01)
    monkeypatch.setattr(brown, "CORE_SHARE", core_share)  # so that many, or none, are scored through the join
    monkeypatch.setattr(brown, "BLOCK_TOKENS", 1500)
    held, rng = settled(monkeypatch), random.Random(2)
    vocabulary = [f"w{i}{chr(97 + i % 7)}" for i in range(3000)]
    texts = [(i, " ".join(vocabulary[int(rng.paretovariate(0.5)) % 3000] for _ in range(40))) for i in range(200)]
    texts += [(1000 + i, "never seen before " * 3 + "w0a W1b w1b\nw2999z\x0bw5f w2900c w2901d") for i in range(9)] + [(2000, None), (2001, ""), (2002, "w7a w7a w7a w7a")]
    got = {r["doc_id"]: r for r in brown.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    test = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    split = {i: [x.decode() for x in brown.tokens((t or "").encode())] for i, t in texts}
    count = Counter(x for i, _ in texts if not test(i) for x in split[i])
    total = sum(count.values())
    w, (cls, step, unknown, _, _) = held["words"], held["model"]
    rare = {x for x, n in count.items() if n < 0.01 * total and x != " "}
    assert set(held["classes"]) == rare and len(rare) > 500
    assert {r["word"]: r["n"] for r in held["rare"].collect()} == {x: count[x] for x in rare}

    def class_of(x):
        if x == " ":
            return 0
        if x in rare:
            return held["classes"][x]
        return int(cls[w.unit[w.index[x.encode()]]]) if x in count else int(cls[w.first_ending + brown.ending(x.encode())])

    g = np.zeros((brown.CLASSES, brown.CLASSES))
    for i, _ in texts:
        if not test(i):
            for a, b in zip([" ", *split[i]], split[i]):
                g[class_of(a), class_of(b)] += 1
    assert np.array_equal(g, held["g"])
    for c in {class_of(x) for x in count}:
        everything = sum(10.0 ** (step[c, class_of(x)] + np.log10(n - brown.DISCOUNT)) for x, n in count.items()) + 10.0 ** unknown[c]
        assert everything == pytest.approx(1.0, abs=1e-9)
    for i, _ in texts:
        want, before = 0.0, " "
        for x in split[i]:
            c = class_of(before)
            want += step[c, class_of(x)] + np.log10(count[x] - brown.DISCOUNT) if x in count else unknown[c]
            before = x
        assert got[i]["score"] == pytest.approx(want), i
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(split[i]), sum(x in count for x in split[i]))


def test_a_move_gains_what_the_likelihood_gains():
    """One word that may move, no neighbour of its own class: it goes where the likelihood is highest."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        g = rng.integers(0, 40, (brown.CLASSES, brown.CLASSES)).astype(float)
        right, left = (np.bincount(rng.integers(8, brown.CLASSES, 30), minlength=brown.CLASSES) for _ in range(2))
        right[9] += 40  # beyond the counts that are looked up
        left[11] += 40
        g[5] += right
        g[:, 5] += left
        code = np.flatnonzero(np.concatenate([right, left]))
        n = np.concatenate([right, left])[code]
        got = brown.moved(np.array([5]), np.zeros(len(code), np.int64), code, n, g, np.array([True]), 1.0)[0]

        def after(c):
            x = g.copy()
            x[5] -= right
            x[:, 5] -= left
            x[c] += right
            x[:, c] += left
            return brown.likelihood(x)

        assert after(got) == pytest.approx(max(after(c) for c in range(1, 8)) if got < 8 else after(got))
        assert after(got) >= max(after(c) for c in range(1, 8)) - 1e-6
        assert after(got) >= after(5) - 1e-6

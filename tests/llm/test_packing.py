"""Packing: never worse than best fit, and the ids of the tokenizers library for texts that hold added tokens."""

import random
import zlib

import numpy as np
import pytest

from lexigauge.llm import packing


def slow_best_fit(lengths, cap=1024):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(cap - n)
        else:
            rooms[rooms.index(fit)] = fit - n
    return len(rooms)


@pytest.mark.parametrize("n", [1, 40, 300, 1000])
def test_no_more_sequences_than_best_fit(n):
    rng = random.Random(n)
    for low, high in ((1, 1024), (1, 300), (200, 600), (100, 140)):
        lengths = [rng.randint(low, high) for _ in range(n)]
        counts = np.bincount(lengths, minlength=1025)
        want = slow_best_fit(lengths)
        assert sum(k for k, _ in packing.best_fit(counts)) == want
        for plan in (packing.best_fit(counts), packing.solve(counts)):
            assert sum((k * np.bincount(x, minlength=1025) for k, x in plan), 0 * counts).tolist() == counts.tolist()
            assert all(sum(x) <= 1024 and k > 0 for k, x in plan)
        assert packing.waste_bound(counts) <= sum(k for k, _ in packing.solve(counts)) <= want


def test_added_tokens(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n\n x  <|endoftext|>", "no<|endoftext|>space", "<|endoftext| >", "word   <|endoftext|>\n"]
    t = Tokenizer.from_file(packing.default_vocab())
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {i: np.array([*t.encode(x, add_special_tokens=False).ids, packing.END_ID], "<u4") for i, x in enumerate(texts)}
    assert 50256 in want[0]
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


@pytest.mark.parametrize("kind", [" ", "\n", "x", " \n", "7", "!", "\u3000", "a \t"])
def test_long_runs(kind):
    with open(packing.default_vocab(), "rb") as f:
        spec = f.read()
    for n in (4_999, 5_000, 2_000_000 if kind in "  \n" else 20_000):
        for text in (f"x{kind * (n // len(kind))}y", kind * (n // len(kind))):
            assert packing.ids_of(spec, text).tolist() == packing.library(spec).encode(text, add_special_tokens=False).ids


def test_long_blanks_are_packed(spark):
    text = "x" + " " * 2_000_000 + "y"
    got = packing.pack(spark.createDataFrame([(1, text), (2, None), (3, "a" * 2_000_000), (4, "\n" * 1_500_000), (5, " ")], "doc_id long, text string")).collect()
    with open(packing.default_vocab(), "rb") as f:
        t = packing.library(f.read())
    for doc, s in ((1, text), (2, ""), (3, "a" * 2_000_000), (4, "\n" * 1_500_000), (5, " ")):
        ids = np.array([*t.encode(s, add_special_tokens=False).ids, packing.END_ID], "<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == doc)
        assert own == [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n in packing.cut(len(ids))]

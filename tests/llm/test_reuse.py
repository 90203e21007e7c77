"""Ids and decoded texts against the tokenizers library, with shared chunks at joins of every kind."""

import hashlib
import random

import pytest

from lexigauge.llm import reuse


@pytest.fixture(scope="module")
def code():
    with open(reuse.default_vocab(), "rb") as f:
        return reuse.codec(f.read())


def plain(code, text):
    ids = code.tokenizer.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(code.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


BITS = ["don't", "I'll", "'re", "é", "̣́", "x̧́", "각", "Å", "क़", "你好", "123", "!!?'", "<|endoftext|>", "<|startof", "text|>", " ", " ", " ", "\n", " ", " ", "İ", "\U0001f468‍\U0001f469", "ß", "word", "Word", "lorem", "ipsum", "--", "ো"]


def made(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def cores_of(code, texts):
    every = {k: t[a:b] for t in texts for ends in reuse.chunks([t]) for k, a, b in zip(reuse.keys(t, ends), [0, *ends], ends)}
    shown = [x.decode() for x in every.values()]
    return {k: c for k, c in zip(every, (reuse.core(t, w, code.margin) for t, w in zip(shown, reuse.words(code, shown)))) if c}


@pytest.mark.parametrize("seed", range(6))
def test_joined_of_all_chunks(code, seed):
    rng = random.Random(seed)
    shared = [made(rng, 300) for _ in range(4)]
    texts = ["".join(rng.choice([rng.choice(shared), made(rng, rng.randint(0, 60))]) for _ in range(6)).encode() for _ in range(60)]
    cores = cores_of(code, texts)
    assert len(cores) > 100 if seed % 2 else cores
    if seed > 2:  # some chunks only
        cores = {k: c for k, c in cores.items() if rng.random() < 0.6}
    assert [code.digest(i) for i in reuse.joined(code, texts, cores)] == [plain(code, t.decode()) for t in texts]


def test_unbroken_and_long(code, monkeypatch):
    rng = random.Random(9)
    texts = ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefg") for _ in range(9000)), "́" * 3000, " " * 5000, "!" * 4000, "x" + "\n" * 4000 + "y", ("é" * 700 + " ") * 5, "日本語" * 900]
    raw = [t.encode() for t in texts]
    monkeypatch.setattr(reuse, "CALL_BYTES", 1000)
    monkeypatch.setattr(reuse, "MEMO", 3)
    assert [code.digest(i) for i in reuse.joined(code, raw, cores_of(code, raw))] == [plain(code, t) for t in texts]
    assert [code.digest(code.ids(t)) for t in texts] == [plain(code, t) for t in texts]


def test_chunks_follow_content():
    rng = random.Random(2)
    body = bytes(rng.randrange(97, 123) for _ in range(40_000))
    a, b = reuse.chunks([body, b"something before " + body])
    assert a[-1] == len(body) and all(x < y for x, y in zip(a, a[1:]))
    one, two = set(reuse.keys(body, a)), set(reuse.keys(b"something before " + body, b))
    assert len(one & two) > 0.9 * len(one)
    sizes = [y - x for x, y in zip([0, *a], a)]
    assert max(sizes) <= reuse.MOST and min(sizes[:-1]) >= reuse.LEAST
    assert reuse.chunks([b"", b"x"]) == [[], [1]]
    for ends in reuse.chunks(["日本語".encode() * 5000]):
        assert all(e % 3 == 0 for e in ends)


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_query(spark, code, bits, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(reuse, "TASK_BYTES", 1 << 16)
    shared = [made(rng, 400) for _ in range(5)]
    texts = [made(rng, 30) + rng.choice(shared) + made(rng, 90) + rng.choice(shared) for _ in range(80)] + [made(rng, 500) for _ in range(20)] + [None, "", " ", shared[0], shared[0]]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(3, texts[3], "n"), (3, texts[4], "n"), (None, texts[5], "n")]
    got = reuse.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3), bits=bits).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *plain(code, t or "")) for i, t, _ in rows], key=str)
    assert reuse.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        raw = f.read()
    with pytest.raises(ValueError):
        reuse.codec(raw)


def test_plain_words_by_rank(code):
    rng = random.Random(6)
    letters = "abcdefghijklmnoprstuvwzäöüßéèêçœæłšžАБВабвгдежзийклмнопрстуфхЁё\u01f0\u0149"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(20_000)] + ["the", "The", "THE", "ǅ", "Ǆ", "x" * 5000]
    assert code.ranks is not None
    for w in words:
        assert code.ids(w) == code.tokenizer.encode(w, add_special_tokens=False).ids, w

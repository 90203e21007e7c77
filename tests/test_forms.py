"""Names, splices, pairs and spans against plain versions and by literal cases."""

import difflib
import random
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigauge.functions import forms
from lexigauge.operators import evaluation, lookups, pairing, spans, stats


@pytest.fixture
def one(spark):
    def run(f, *cells):
        df = spark.createDataFrame([cells], ", ".join(f"c{i} string" for i in range(len(cells))))
        return df.select(f(*[F.col(f"c{i}") for i in range(len(cells))]).alias("x")).first()["x"]

    return run


@pytest.mark.parametrize("name, short", [("Ur of Chaldea", "Ur"), ("Kingdom of Ur", None), ("Rim IV", "Rim"), ("Ur", None), ("Anna, the Elder", "Anna"), ("", None), (None, None), ("Ур of X", None)])
def test_short_form(one, name, short):
    assert one(forms.short_form, name) == short


def test_entity(one):
    full = {"labels": {"en": {"value": "Ur of Chaldea"}}, "aliases": {"en": [{"value": "Urim"}, {"value": "𒋀"}, {"value": "Ur of Chaldea"}]}, "sitelinks": {"enwiki": {"title": "Ur"}}, "descriptions": {"en": {"value": "a town"}}}
    of = lambda f: lambda c: f(forms.entity(c))
    assert one(of(forms.latin_forms), json.dumps(full)) == ["Ur of Chaldea", "Urim", "Ur"]
    assert one(of(forms.latin_forms), "{}") == [] and one(of(forms.description), "{}") == "" and one(of(forms.aliases), "{}") == []
    assert (one(of(forms.label), json.dumps(full)), one(of(forms.site_title), json.dumps(full)), one(of(forms.description), json.dumps(full))) == ("Ur of Chaldea", "Ur", "a town")


@pytest.mark.parametrize("surface, context, names", [("Унку", "был Унку, и Унку (Unqi, или Уна) тут", ["Unqi", "Уна"]), ("a.b", "axb (q)", []), ("a\\Eb", "a\\Eb (q)", ["q"]), ("Q", "Q ()", []), ("", "(x)", []), ("Q", None, [])])
def test_alternates(one, surface, context, names):
    assert one(forms.alternates, surface, context) == names


@pytest.mark.parametrize("target, fragment, said, result", [
    ("they were partly drawn into it now", "drawn into", "partly taken in", "they were partly taken in it now"), ("a  b\tc", "b c", "X", "a  X"), ("go to town", "go", "walk to", "walk to town"),
    ("a b", "z", "y", None), ("a b", "", "y", None), ("a b", "  ", "y", None), ("a+b (c)", "a+b", "q", "q (c)"), ("one two three", "two", "one  2  three", "one 2 three"), ("x", "x", "", "")])
def test_spliced(one, target, fragment, said, result):
    assert one(forms.spliced, target, fragment, said) == result


def test_places(one):
    assert one(forms.occurrences, "aaaa", "aa") == [0, 1, 2] and one(forms.occurrences, "abc", "") == [0, 1, 2]
    assert one(forms.occurrences, "a", "abc") == [] and one(forms.occurrences, "", "a") == [] and one(forms.occurrences, "", "") == []
    assert tuple(one(forms.match_span, "The Cat sat", "cat")) == ("The ", "Cat", " sat") and one(forms.match_span, "x", "") is None
    assert one(forms.sentence_with, "One here.  Two cats!\nThree.", "CATS") == "Two cats!" and one(forms.sentence_with, "One. Two", "z") is None
    assert one(forms.sentence_with, "One. Two", " two") == "One." and one(forms.sentence_with, "e.g.x is. B", "x") == "e.g.x is."


def test_gazetteer(one):
    lexicon = [("Ур", "place"), ("царь", "role"), ("Ур", "other"), ("c++", None)]
    found = one(lambda t: forms.gazetteer(t, lexicon), "Урук, царь и Ур (c++), шумерцы, бойцы, Горцы, самаряне, шумерцы, инане")
    assert [tuple(x) for x in found] == [("Ур", "place"), ("царь", "role"), ("c++", None), ("шумерцы", "people"), ("самаряне", "people")]
    assert one(lambda t: forms.gazetteer(t, []), "") == []


def plain_pair(names, target):
    words, best = target.split(), (0.0, None)
    for form in names:
        if form.lower() in target.lower():
            at = target.lower().find(form.lower())
            return target[at : at + len(form)], "green", None
    for form in names:
        k = len(form.split())
        head = next((p for p in form.lower().split() if len(p) > 2), (form.lower().split() or [""])[0])
        for i in range(len(words) - k + 1):
            sim = difflib.SequenceMatcher(None, " ".join(words[i : i + k]).lower(), " ".join(form.lower().split())).ratio()
            if k and sim > best[0] and (sim >= 0.95 or any(head in w.lower() for w in words[i : i + k])):
                best = (sim, " ".join(words[i : i + k]))
    if best[0] >= 0.9:
        return best[1], "green", None
    return (best[1], "yellow", names[0]) if best[0] >= 0.7 else (None, "red", names[0])


def test_pair_against_all_windows(spark):
    rng, vocabulary = random.Random(4), ["Sargon", "sargon", "Sargo", "of", "Akkad", "Akad", "town", "the", "Ur"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, n)))
    rows = [(i, [some(4) for _ in range(rng.randint(1, 3))], some(6)) for i in range(400)]
    got = {r["id"]: tuple(r["pair"]) for r in pairing.pair(spark.createDataFrame(rows, "id int, f array<string>, t string"), F.col("f"), F.col("t")).collect()}
    assert got == {i: plain_pair(f, t) for i, f, t in rows}
    assert {v[1] for v in got.values()} == {"green", "yellow", "red"}


def test_pair(spark):
    rows = spark.createDataFrame([(1, ["Sargon of Akkad"], "the town of Akkad"), (2, None, "x"), (3, ["a", None], None), (4, ["Ur"], "in UR now"), (5, [], "x"), (6, [""], "x y")], "id int, f array<string>, t string")
    got = {r["id"]: tuple(r["pair"]) for r in pairing.pair(rows, F.col("f"), F.col("t")).collect()}
    assert got == {1: (None, "red", "Sargon of Akkad"), 2: (None, "red", None), 3: (None, "red", "a"), 4: ("UR", "green", None), 5: (None, "red", None), 6: ("", "green", None)}


@given(st.text("ab", max_size=14), st.lists(st.none() | st.text("ab", max_size=3), max_size=7))
def test_in_turn(text, surfaces):
    taken, out = set(), []
    for place, s in enumerate(surfaces, 1):
        for at in range(len(text) - len(s or "") + 1 if s else 0):
            here = set(range(at, at + len(s)))
            if text.startswith(s, at) and not here & taken:
                taken |= here
                out.append((at, at + len(s), place))
                break
    assert spans.claimed_in_turn(text, surfaces) == out


@given(st.integers(0, 9), st.lists(st.tuples(st.integers(-1, 10), st.integers(-1, 10)), max_size=7))
def test_shown(length, ranges):
    order = sorted(((a, b, i) for i, (a, b) in enumerate(ranges, 1) if a >= 0 and b <= length and a < b), key=lambda r: (r[0], -r[1], r[2]))
    host = {}
    for r in order:
        inside = [o for o in order if o[2] not in host and o != r and o[0] <= r[0] and r[1] <= o[1]]
        if inside:
            host[r[2]] = inside[0][2]
    out, end = [], 0
    for r in (r for r in order if r[2] not in host and True):
        if r[0] >= end:
            out.append((*r, None))
            out += [(*c, r[2]) for c in order if host.get(c[2]) == r[2]][:1]
            end = r[1]
    assert spans.shown(length, ranges) == out


def test_bad_parameter(spark):
    cases = [({"top_k": "3"}, None), ({"top_k": "1.5"}, "top_k"), ({"temperature": "true"}, "temperature"), ({"min_p": "-1e9"}, None), ({"reasoning": "3"}, "reasoning"), ({"reasoning": '{"effort":null}'}, None),
             ({"reasoning": '{"x":1}'}, "reasoning"), ({"enable_thinking": "1"}, "enable_thinking"), ({"zoom": "1", "max_tokens": "0"}, "max_tokens"), ({"seed": None}, "seed"), ({}, None), (None, None)]
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p map<string,string>")
    got = {r["i"]: r["b"] for r in rows.select("i", lookups.first_bad_parameter(F.col("p")).alias("b")).collect()}
    assert got == {i: b for i, (_, b) in enumerate(cases)}


def test_no_rows(spark):
    none = spark.createDataFrame([], "title string, qid string, source string")
    assert tuple(evaluation.contamination(none, none, "sitelink").first()) == (0, 0, 0, None, 0, 0, None, None, None, 0)
    x = spark.createDataFrame([("a", None, 1.0), ("a", 2.0, None)], "k string, x double, y double")
    assert [tuple(r) for r in stats.spearman_grid(x, "k", ["x"], ["y"]).collect()] == [("a", "x", "y", 0, None)]
    assert [tuple(r) for r in stats.tie_summary(x.where("x is null"), "k", "x").collect()] == [("a", 0, 0, None, None, None, None)]

"""The search ladder against a walk over each mention, its three-valued answers, and grounding by names and decisions."""

import random

import pytest

from lexigauge.functions.text import norm_text
from lexigauge.operators import ladder

ENTITY = "id string, qid string, label_ru string, label_en string, description string, aliases_ru array<string>, aliases_en array<string>"


def walk(m, answers, entities, guess, c):
    """(source, n_hits, queries, [(qid, tier)]) of one mention."""
    surface, lemma, alts = m[1] or "", m[2] or "", m[3]
    shapes = ([lemma] if c.use_lemma and lemma and lemma != surface else []) + ([surface] if surface else [])
    kind = lambda q: "lemma" if q == lemma else "surface"
    rungs = [([(q, kind(q)) for q in shapes], ladder.PREFIX, ladder.PREFIX, "baseline")]
    if c.use_full_text:
        rungs.append(([(q, kind(q)) for q in shapes], ladder.FULL_TEXT, ladder.FULL_TEXT, "baseline"))
    if c.use_page and (lemma or surface):
        rungs.append(([(lemma or surface, kind(lemma or surface))], ladder.PAGE, ladder.PAGE_SOURCE, "baseline"))
    if c.widen != "baseline":
        rungs.append(([(q, "alt") for q in alts], ladder.PREFIX, "alt", "alt"))
    if c.widen == "label-guess":
        rungs.append(([(q, "label_guess") for q in guess if q], ladder.PREFIX, "label_guess", "label_guess"))
    queries = []
    for words, mechanism, source, tier in rungs:
        hits, never = [], False
        for q, k in words:
            ids = answers.get((mechanism, q))
            never |= ids is None
            ids = (ids or [])[: 1 if mechanism == ladder.PAGE else c.search_limit]
            queries.append((q, k, mechanism, len(ids)))
            hits += [i for i in ids if i not in hits]
        if never:
            return "unknown", 0, queries, []
        if hits:
            return source, len(hits), queries, [(entities[i], tier) for i in hits[: c.enrich_top] if i in entities]
    return "none", 0, queries, []


@pytest.mark.parametrize("config", [ladder.Config(), ladder.Config(widen="label-guess"), ladder.Config(use_lemma=False, use_full_text=False, use_page=False, widen="alt-names", search_limit=2, enrich_top=1)])
def test_every_mention(spark, config):
    rng = random.Random(11)
    words = ["Ur", "Uri", "Akkad", "akk", "Nippur", "x"]
    answers = {(m, q): [f"Q{rng.randrange(12)}" for _ in range(rng.choice([0, 0, 0, 1, 3, 9]))] for m in (ladder.PREFIX, ladder.FULL_TEXT, ladder.PAGE) for q in words if rng.random() < 0.85}
    answers = {k: list(dict.fromkeys(v)) for k, v in answers.items()}
    entities = {f"Q{i}": f"Q{i - 1 if i % 4 == 3 else i}" for i in range(10)}
    mentions, guesses = [], {}
    for i in range(150):
        s, alts = rng.choice([*words, "", None]), rng.sample(words, rng.randint(0, 2))
        context = f"about {s} ({', '.join(alts)})" if alts and s else None
        mentions.append((i, s, rng.choice([None, "", s, *words]), alts if context else [], context))
        if rng.random() < 0.7:
            guesses[i] = (rng.choice([None, "", *words]), rng.choice([None, *words]))
    frame = spark.createDataFrame([(m[0], m[1], m[2], m[4]) for m in mentions], "mention_id int, surface string, lemma string, context string")
    known = spark.createDataFrame([(m, q, ids) for (m, q), ids in answers.items()], "mechanism string, q string, hits array<string>")
    ents = spark.createDataFrame([(i, q, "l" + q, None, None, [], None) for i, q in entities.items()], ENTITY)
    said = spark.createDataFrame([(i, *g) for i, g in guesses.items()], "mention_id int, label_ru string, label_en string")
    got = {r["mention_id"]: (r["source"], r["n_hits"], [tuple(q) for q in r["queries"]], [(x["qid"], x["tier"]) for x in r["candidates"]]) for r in ladder.candidates(frame, known, ents, said, config).collect()}
    want = {m[0]: walk(m, answers, entities, guesses.get(m[0], ()), config) for m in mentions}
    assert got == want
    assert len({v[0] for v in want.values()}) > 2


def test_names_and_decisions(spark):
    c = [("Q1", "Ур", None, "a city", ["Ёр"], ["Ur"]), ("Q2", "ур", None, "a god", None, []), ("Q3", None, "Ur", "x", [], ["UR"])]
    kind = "array<struct<place:int,qid:string,label_ru:string,label_en:string,description:string,aliases_ru:array<string>,aliases_en:array<string>,tier:string>>"
    cands = lambda *ids: [(n, *next(x for x in c if x[0] == i), "baseline") for n, i in enumerate(ids)]
    rows = [(1, "Ер", "", "p", cands("Q1", "Q3")), (2, "УР", "", "p", cands("Q1", "Q2")), (3, "УР", "", "q", cands("Q2", "Q1")), (4, "zz", "", "p", cands("Q3")), (5, "zz", "", "q", cands("Q3")), (6, "u", "ur", "p", cands("Q3", "Q1")), (7, "a", "", "p", []), (8, "a", "", "p", [])]
    found = spark.createDataFrame([(i, s, m, "unknown" if i == 8 else "none", x, d) for i, s, m, d, x in rows], f"mention_id int, surface string, lemma string, source string, candidates {kind}, doc string")
    exact = {(r["mention_id"], r["qid"]): (r["kind"], r["value"], r["query"]) for r in ladder.exact_matches(found).collect()}
    assert exact == {(1, "Q1"): ("alias_ru", "Ёр", "Ер"), (2, "Q1"): ("label_ru", "Ур", "УР"), (2, "Q2"): ("label_ru", "ур", "УР"), (3, "Q1"): ("label_ru", "Ур", "УР"), (3, "Q2"): ("label_ru", "ур", "УР"), (6, "Q3"): ("alias_en", "UR", "ur"), (6, "Q1"): ("alias_en", "Ur", "ur")}
    assert norm_text("Ёр") == norm_text("Ер")
    said = [("p", "ур", ["Q1", "Q2"], True, "Q2"), ("q", "ур", ["Q1", "Q2"], True, None), ("p", "zz", ["Q3"], True, "Q9"), ("q", "zz", ["Q3"], False, "Q3")]
    decisions = spark.createDataFrame(said, "scope string, term string, ids array<string>, answered boolean, qid string")
    got = {r["mention_id"]: (r["resolved_by"], r["difficulty"], r["chosen"]) for r in ladder.grounded(found, decisions, found["doc"]).collect()}
    assert got == {
        1: ("exact_label", "green", "Q1"), 2: ("llm_disambiguation", "yellow", "Q2"), 3: ("judge_rejected", "red", None), 4: ("judge_unavailable", "yellow", None),
        5: ("judge_unavailable", "yellow", None), 6: ("judge_unavailable", "yellow", None), 7: ("no_candidates", "red", None), 8: ("unknown", None, None),
    }
    assert ladder.exact_matches(found, match_aliases=False).where("mention_id = 6").count() == 0


def test_plausibility(spark):
    rows = [("an ancient city", None, False), ("A comic about a river", None, True), ("ruler of Sumer", "place", True), ("ruler of Sumer", "person", False), (None, None, True), ("a car", None, True), ("Wikimedia disambiguation page of a city", None, True)]
    df = spark.createDataFrame([r[:2] for r in rows], "d string, t string")
    assert [r[0] for r in df.select(ladder.implausible(df["d"], df["t"])).collect()] == [r[2] for r in rows[:1]] + [True] + [r[2] for r in rows[2:]]


def test_rungs_climb_by_one_join(spark, monkeypatch):
    m = spark.createDataFrame([(1, "Ur", "", "Ur (Uri, Nippur)"), (2, "x", "y", "")], "mention_id int, surface string, lemma string, context string")
    answers = spark.createDataFrame([(ladder.PREFIX, "Ur", []), (ladder.FULL_TEXT, "Ur", []), (ladder.PAGE, "Ur", []), (ladder.PREFIX, "Uri", ["Q1"]), (ladder.PREFIX, "Nippur", ["Q1", "Q2"]), (ladder.PREFIX, "x", ["Q1"])], "mechanism string, q string, hits array<string>")
    ents = spark.createDataFrame([("Q1", "Q1", "l", None, None, [], None)], ENTITY)
    cuts = []
    monkeypatch.setattr(ladder, "cut", lambda df: cuts.append(df) or df)
    out = {r["mention_id"]: (r["source"], r["n_hits"], [(q["q"], q["n_hits"]) for q in r["queries"]], [c["qid"] for c in r["candidates"]]) for r in ladder.candidates(m, answers, ents, config=ladder.Config(widen="alt-names")).collect()}
    assert out == {1: ("alt", 2, [("Ur", 0), ("Ur", 0), ("Ur", 0), ("Uri", 1), ("Nippur", 2)], ["Q1"]), 2: ("unknown", 0, [("y", 0), ("x", 1)], [])}
    assert len(cuts) == 3  # mentions, what they climbed, the result; each rung was written and dealt by itself

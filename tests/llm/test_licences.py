"""Licence texts wrapped to lines, between prose, in comments and beside other notices."""

import textwrap

import pytest

from lexigauge.llm import licenses

PROSE = "The ferry leaves at noon and the harbour is quiet until then, as most people of the town are at work."


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r["doc_id"]: (r["families"], r["n_licence"], r["n_unknown"]) for r in licenses.scan(docs).collect()}


def test_wrapped_texts_are_found(spark):
    texts, want = [], []
    for family, all_of in licenses.TEXTS.items():
        for width in (24, 40, 70, 80):
            for lead in ("", "# ", " * "):
                wrapped = "\n".join(lead + x for x in textwrap.wrap(all_of[0], width))
                texts += [wrapped, f"{PROSE}\n{wrapped}\n{PROSE}"]
                want += [family] * 2
    got = scan(spark, texts)
    assert [(k, got[k][0], f) for k, f in enumerate(want) if f not in got[k][0].split(",")] == []


def test_notices_beside_each_other(spark):
    texts = [
        f"{PROSE}\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\n{PROSE}",
        "Licensed under the GNU Affero\nGeneral Public License, version 3",
        "Licensed under the GNU Lesser\n\nGeneral Public things",
        "Kept in the public\ndomain of the town",
        f"{PROSE}\nThe poetic license of the facts.\n{PROSE}",
    ]
    got = scan(spark, texts)
    assert got[0] == ("Apache,MIT", 2, 0)
    assert got[1][:2] == ("AGPL", 1)
    assert [got[k][:2] for k in (2, 3, 4)] == [("", 0)] * 3


@pytest.mark.parametrize("wrapped", ["All rights\nreserved", "all\n# rights reserved", "free\n * software", "Creative\nCommons"])
def test_cues_across_lines(spark, wrapped):
    docs = spark.createDataFrame([(1, f"first\n{wrapped}\nlast")], "doc_id int, text string")
    assert licenses.scan(docs).first()["n_candidates"] == 1

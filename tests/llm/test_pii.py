"""Disguises beside plain text: addresses of which a part is plain, and numbers with spelled dots."""

import pytest

from lexigauge.llm import pii


def found(text):
    base, added = pii.find(text)
    return [(pii.KINDS[k], text[s:e]) for s, k, e in base], [(pii.KINDS[k], text[s:e]) for s, k, e in added]


@pytest.mark.parametrize(
    "text, plain, whole",
    [
        ("to jоhn.smith@example.com now", "hn.smith@example.com", "jоhn.smith@example.com"),
        ("to a@b.co.exаmple.com now", "a@b.co.ex", "a@b.co.exаmple.com"),
        ("to bob@mail.example.cоm now", "bob@mail.example.c", "bob@mail.example.cоm"),
    ],
)
def test_the_whole_address_is_added_to_its_plain_part(text, plain, whole):
    assert found(text) == ([("email", plain)], [("email", whole)])


def test_nothing_is_added_that_a_plain_span_covers():
    assert found("x\u200by bob@example.com, z") == ([("email", "bob@example.com")], [])


@pytest.mark.parametrize(
    "address",
    ["192 dot 168 dot 1 dot 1", "192 punkt 168 punkt 1 punkt 1", "192 dot 168 dot one dot one", "one nine two dot one six eight dot 1 dot 1", "10 DOT 0 DOT 0 DOT 255"],
)
def test_spelled_dots(address):
    assert found(f"host 80 {address}, ok") == ([], [("ip", address)])


@pytest.mark.parametrize("text", ["see 3 dot 4 dot 5 here", "300 dot 400 dot 500 dot 600", "it scored 9 point 5, then 8 point 1"])
def test_numbers_that_are_no_address(text):
    assert found(text) == ([], [])

from __future__ import annotations

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from centime.llm.words import blocks, words


def plain(text):
    folded = unicodedata.normalize("NFD", text.lower())
    return re.findall(r"[^\W_]+", "".join(c for c in folded if unicodedata.category(c) not in ("Mn", "Me")))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aàéÀ́1_ -\n²🙂е", max_size=20)), max_size=6))
def test_words_are_runs_of_letters_and_digits(texts):
    found = words(texts)
    names = {}
    for i, text in enumerate(texts):
        hashes, expected = found.hash[found.first[i] : found.first[i + 1]].tolist(), plain(text or "")
        assert len(hashes) == len(expected)
        for h, w in zip(hashes, expected, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_blocks_cover_everything():
    texts = ["a" * 10, None, "b" * 50, "", "c" * 5]
    assert list(blocks(texts, 12)) == [(0, 2), (2, 3), (3, 5)]
    assert list(blocks([], 12)) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aàéÀ\u0301\u1100\u1161\u11a81_ -\n²🙂е", max_size=40)), max_size=5), st.integers(3, 12))
def test_texts_in_parts_have_the_same_words(texts, part):
    from centime.llm import words as module

    whole, before = words(texts), module.PART
    try:
        module.PART = part
        parts = words(texts)
    finally:
        module.PART = before
    assert all(a.tolist() == b.tolist() for a, b in zip(whole, parts, strict=True))


def test_very_long_texts():
    from centime.llm.words import PART, hash_words

    assert len(hash_words("mot été " * (PART // 8 + 1))) == 2 * (PART // 8 + 1)
    assert len(hash_words("x" * (PART + 1))) == 1
    assert hash_words("x" * (PART + 1))[0] != hash_words("x" * (PART + 2))[0]
    assert len(hash_words("a " + "x" * (2 * PART + 3) + " b")) == 3

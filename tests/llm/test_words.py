"""Array hashing of words and shingles against a plain reading."""

from __future__ import annotations

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sigtrail.llm.words import shingle_sets, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_shingles(text, k):
    found = plain_words(text)
    return {tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é \n\t\x0b", max_size=30)), max_size=8), st.integers(1, 4))
def test_hashes_stand_for_words_and_shingles(texts, k):
    column = pa.array(texts, pa.string())
    found = words(column)
    seen = {}
    for i, text in enumerate(texts):
        own = found.hashes[found.first[i] : found.first[i + 1]].tolist()
        assert len(own) == len(plain_words(text))
        for word, code in zip(plain_words(text), own):
            assert seen.setdefault(word, code) == code
    assert len(set(seen.values())) == len(seen)
    assert [len(s) for s in shingle_sets(column, k)] == [len(plain_shingles(t, k)) for t in texts]


def test_slices_of_a_column_are_hashed_alike():
    column = pa.array(["a b c d", None, "x", "a b c d e", ""])
    whole = [s.tolist() for s in shingle_sets(column, 3)]
    assert [s.tolist() for s in shingle_sets(column.slice(2, 2), 3)] == whole[2:4]

"""Containment search against a plain count of shingles."""

from __future__ import annotations

import random

import pytest

from sigtrail.llm.decontaminate import clean, contained, lacking, sketch_length
from tests.llm.test_words import plain_shingles


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 9, 20, 60])))) for i in range(40)] + [(40, None), (41, ""), (42, "One"), (None, "no id here at all ok")]
    docs = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 400))]
        if i % 2:
            passage = (items[i % 40][1] or "").split()
            for _ in range(rng.randint(0, 3)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() for w in passage]
        docs.append((i, "\n".join(text)))
    docs += [(500, None), (501, ""), (502, "one"), (503, items[3][1]), (503, items[3][1]), (None, items[3][1]), (504, "w1 " * 40_000 + items[4][1])]
    return docs, items


@pytest.mark.parametrize("bound", [1 << 20, 5])
def test_search_equals_plain_count(spark, documents, corpus, bound):
    docs, items = corpus
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc, r.item_id, r.n_shared, r.n_item) for r in contained(documents(docs).withColumnRenamed("lang", "doc"), table, max_broadcast=bound).collect()}
    want = set()
    for doc_id, text in docs:
        own = plain_shingles(text, 5)
        for item_id, item in items:
            needed = plain_shingles(item, 5)
            if doc_id is not None and item_id is not None and needed and 10 * len(own & needed) >= 8 * len(needed):
                want.add((doc_id, item_id, len(own & needed), len(needed)))
    assert got == want and len(want) > 10


def test_clean_drops_what_contains_an_item(spark, documents, corpus):
    docs, items = corpus
    table = spark.createDataFrame(items, "item_id long, text string")
    gone = {r.doc for r in contained(documents([(k, text) for k, (_, text) in enumerate(docs)]), table).collect()}
    left = clean(documents(docs), table)
    assert left.columns == documents([]).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for k, (i, _) in enumerate(docs) if k not in gone)


def test_empty_tables(spark, documents, corpus):
    docs, items = corpus
    none = spark.createDataFrame([], "item_id long, text string")
    assert contained(documents(docs), none).count() == 0
    assert contained(documents([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_a_sketch_is_longer_than_what_may_lack():
    for n in range(1, 3000):
        assert sketch_length(n, 0.8) > lacking(n, 0.8)

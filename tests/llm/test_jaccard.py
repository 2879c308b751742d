"""Components of near copies against a plain comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sigtrail.llm.jaccard import Similarity, keep_first, near_classes, prefix
from tests.llm.test_words import plain_shingles


def plain_components(sets, linked):
    """Smallest id of each component; ids with equal sets are compared like others."""
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if linked(sets[a], sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in ids}


def near_copies(rng, groups):
    words = [f"w{i}" for i in range(500)]
    rows, number = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 40, 120]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((number, " ".join(copy)))
            number += 1
    return rows


@pytest.mark.parametrize("like,block", [(Similarity(3, 90), 512), (Similarity(5, 80), 4), (Similarity(1, 60), 8)])
def test_components_equal_all_pairs(spark, documents, like, block):
    rows = near_copies(random.Random(block), 25)
    sets = {i: plain_shingles(t, like.k) for i, t in rows}
    want = plain_components(sets, lambda a, b: bool(a) and like.denominator * len(a & b) >= like.numerator * len(a | b))
    got = near_classes(documents(rows), like, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_nulls_and_repeated_rows(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (3, text + " more"), (None, text), (None, None), (8, ""), (9, None), (10, " \n "), (11, "one"), (12, "ONE"), (13, "w " * 30_000)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_classes(documents(rows), Similarity(3, 90)).collect())
    assert got == sorted([("5", 58, "3"), ("5", 58, "3"), ("3", 59, "3"), ("None", 58, "3"), ("None", 0, "None"), ("8", 0, "8"), ("9", 0, "9"), ("10", 0, "10"), ("11", 1, "11"), ("12", 1, "11"), ("13", 1, "13")])
    kept = keep_first(documents(rows), Similarity(3, 90))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "None", "8", "9", "10", "11", "13"])


def test_no_rows(spark, documents):
    assert near_classes(documents([]), Similarity()).count() == 0


def test_prefixes_of_similar_sets_meet_often_enough():
    rng = np.random.default_rng(1)
    like = Similarity(3, 80)
    frequency = rng.integers(0, 50, 1000)
    for _ in range(300):
        union = rng.choice(1000, rng.integers(2, 200), replace=False)
        cut = int(len(union) * 0.1)
        a, b = np.sort(union[cut:]).astype(np.uint64), np.sort(union[: len(union) - cut]).astype(np.uint64)
        shared = len(np.intersect1d(a, b))
        if like.denominator * shared >= like.numerator * len(union):
            (one, m), (two, n) = prefix(a, frequency[a.astype(int)], 3.0, like), prefix(b, frequency[b.astype(int)], 3.0, like)
            assert len(np.intersect1d(one, two)) >= min(m, n)


@pytest.mark.parametrize("like,block", [(Similarity(3, 90), 512), (Similarity(1, 60), 8)])
def test_links_equal_all_pairs(spark, documents, like, block):
    rows = near_copies(random.Random(block), 12)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:9])] + [(2000, ""), (2001, None)]
    sets = {i: plain_shingles(t or "", like.k) for i, t in rows}
    linked = lambda a, b: bool(a) and like.denominator * len(a & b) >= like.numerator * len(a | b)
    want = {i: (sum(linked(s, sets[j]) for j in sets if j != i), min(j for j in sets if sets[j] == s) if s else i, c) for (i, s), c in zip(sorted(sets.items()), plain_components(sets, linked).values())}
    got = near_classes(documents(rows), like, block=block, links=True).collect()
    assert len(got) == len(rows) and max(w[0] for w in want.values()) > 3
    assert {r.doc_id: (r.n_links, r.class_id, r.component_id) for r in got} == want


def test_one_row_of_a_group_stays_whatever_its_id(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (None, text + " more"), (4, "other words " * 3), (4, text), (4, text)]
    kept = sorted((str(r.doc_id), r.text) for r in keep_first(documents(rows), Similarity(3, 90)).collect())
    assert kept == [("4", "other words " * 3), ("4", text)]

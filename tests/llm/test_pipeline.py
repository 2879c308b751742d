"""The pipeline's stages on the smallest tables, each against a plain reading."""

from __future__ import annotations

import pytest

import corpus_pipeline
from sigtrail.llm import quality
from sigtrail.llm.queries import QUERIES, SQL
from sigtrail.llm.scratch import staged, table
from tests.llm.test_jaccard import plain_components
from tests.llm.test_mixing import expected as plain_mixture
from tests.llm.test_sharding import check as check_shards
from tests.llm.test_words import plain_shingles

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents before and after every stage."""
    frames = [table(spark, SMALL, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(staged(stage(spark, frames[-1], SMALL)))
    return [{r.doc_id: r for r in df.collect()} for df in frames], [df.columns for df in frames]


def test_stages_keep_the_columns(kept):
    _, columns = kept
    assert all(c == columns[0] for c in columns[:-1])
    assert set(columns[0]) <= set(columns[-1]) and {"size", "shard", "slot"} <= set(columns[-1])


def test_rejected_documents_are_those_scored_low(spark, kept):
    (docs, good, *_), _ = kept
    chain = quality.fit(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    scores = {r.doc_id: r.score for r in quality.score(table(spark, SMALL, "documents"), chain).collect()}
    assert set(good) == {i for i in docs if scores[i] >= corpus_pipeline.LEAST_SCORE}
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    assert sum((i in good) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)


def test_one_document_of_each_group_stays(kept):
    (_, good, single, *_), _ = kept
    sets = {i: plain_shingles(r.text, 5) for i, r in good.items()}
    names = plain_components(sets, lambda a, b: bool(a) and 5 * len(a & b) >= 4 * len(a | b))
    assert set(single) == set(names.values())


def test_documents_with_a_benchmark_item_go(spark, kept):
    (_, _, single, fair, *_), _ = kept
    items = [s for s in (plain_shingles(r.text, 5) for r in table(spark, SMALL, "benchmark").collect()) if s]
    leaks = {i for i, r in single.items() if any(5 * len(s & plain_shingles(r.text, 5)) >= 4 * len(s) for s in items)}
    assert set(fair) == set(single) - leaks


def test_the_mixture_follows_the_budgets(kept):
    (*_, fair, mixed, _), _ = kept
    number = lambda s: int(s[3:])
    domain = lambda s: "web" if number(s) < 10 else "books" if number(s) < 15 else "code"
    want = plain_mixture([(r.doc_id, r.text, r.lang, r.source) for r in fair.values()], corpus_pipeline.ONE_EPOCH, domain)
    assert set(mixed) == {i for i, _, _ in want} and 0 < len(mixed) < len(fair)


def test_shards_hold_what_is_left(kept):
    (*_, mixed, dealt), _ = kept
    assert set(dealt) == set(mixed)
    check_shards([r.asDict() for r in dealt.values()], 24, 0.002)


def test_queries_are_complete():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)

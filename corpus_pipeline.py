"""The corpus pipeline: quality, near copies, benchmark passages, mixture, shards.

Every stage takes all documents that its predecessor kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigtrail.llm import decontaminate, jaccard, mixing, quality, sharding
from sigtrail.llm.queries import MIXTURE, domain
from sigtrail.llm.scratch import staged, table

LEAST_SCORE = 0.3
"""Documents that the quality classifier scores below this are rejected."""
NEAR = jaccard.Similarity(k=5, numerator=80)
"""Near copies: 80 % of five-word shingles."""
ONE_EPOCH = MIXTURE._replace(percent=80, max_epochs=1)
"""80 % of the tokens that are left, no document more than once."""


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain over lines doesn't reject."""
    chain = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, chain, column="_score").where(f"_score >= {LEAST_SCORE}").drop("_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard.keep_first(docs, NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budgets of their domain, language and source."""
    return mixing.mix(docs, ONE_EPOCH, domain()).select(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, in 24 shards of nearly equal bytes."""
    return sharding.shard(docs, shards=24)


STAGES = [
    ("quality classifier", drop_bad),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix_sources),
    ("sharding", deal_shards),
]

ORACLE_SQL = None
"""The first stage trains a model; the stages are tested against plain loops instead."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole ``documents``; each is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

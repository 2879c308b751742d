"""The chain against sums over all labellings, and held-out accuracy."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sigtrail.llm import quality
from sigtrail.llm.scratch import table

SMALL = "/root/testdata/sf0.01"


def test_marginals_equal_sums_over_labellings():
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 4, 8])
    features = rng.normal(size=(8, 5))
    chain = quality.Chain(rng.normal(size=5), rng.normal(size=(2, 2)))
    got = quality.forward_backward(chain, features, first)
    total = 0.0
    for a, b in zip(first[:-1], first[1:]):
        weights = {}
        for y in product((0, 1), repeat=b - a):
            score = sum(features[a + t] @ chain.emit for t in range(b - a) if y[t]) + sum(chain.move[y[t - 1], y[t]] for t in range(1, b - a))
            weights[y] = np.exp(score)
        z = sum(weights.values())
        total += np.log(z)
        for t in range(b - a):
            assert np.isclose(got.good[a + t], sum(w for y, w in weights.items() if y[t]) / z)
    assert np.isclose(got.log_z, total)
    assert np.isclose(got.moves.sum(), sum(np.diff(first) - 1))


def test_lines_of_a_batch():
    texts = pa.array(["a b\nc\n", "", None, "x", "\n", "é " * 30_000])
    lines = quality.line_features(texts)
    assert np.diff(lines.first).tolist() == [3, 1, 1, 1, 2, 1]
    alone = quality.line_features(pa.array(["a b\nc\n"]))
    assert np.allclose(alone.features, lines.features[:3])
    assert np.isfinite(lines.features).all()


def test_held_out_documents_are_told_apart(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    scored = quality.score(docs, quality.fit(docs, labels)).where(quality.held_out())
    pairs = scored.join(labels, "doc_id").select("score", "quality").toPandas()
    assert len(pairs) > 50
    assert ((pairs.score >= 0.3) == (pairs.quality == 1)).mean() > 0.97


def test_odd_rows_and_empty_tables(spark, documents):
    schema = "doc_id long, quality int, toxic int"
    rows = [(i, "A good line of words, as it should be.\nAnd more." if i % 2 else "X!! X!! X!! X!! X!!") for i in range(40)]
    odd = [(None, "Good words."), (50, None), (51, ""), (52, ""), (3, rows[3][1]), (53, "word " * 50_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, None, 0), (999, 1, 0), (3, 1, 0)], schema)
    docs = documents(rows + odd).withColumn("score", F.lit("mine"))
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1
    assert min(r.score for r in got if r.doc_id is not None and r.doc_id < 40 and r.doc_id % 2) > max(r.score for r in got if r.doc_id is not None and r.doc_id < 40 and not r.doc_id % 2)
    none = quality.fit(docs, spark.createDataFrame([], schema))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(documents([]), none).count() == 0

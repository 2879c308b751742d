"""Near vectors against the cosines of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sigtrail.llm import vectors
from tests.llm.test_jaccard import plain_components


def expected(rows, cosine):
    usable = {i: (np.array(v, dtype=float), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}

    def linked(a, b):
        (x, p), (y, q) = a, b
        return p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine

    parts = plain_components(usable, linked)
    links = {i: sum(i != j and linked(a, b) for j, b in usable.items()) for i, a in usable.items()}
    return {i: (links.get(i, 0), parts.get(i, i)) for i, _, _ in rows}


@pytest.mark.parametrize("cell_rows,block", [(2048, 1024), (20, 16)])
def test_links_equal_all_pairs(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(cell_rows)
    rows = []
    for i in range(260):
        if i and rng.random() < 0.6:
            _, base, label = rows[rng.integers(len(rows))]
            vector = [float(np.float32(x)) for x in np.array(base) + rng.normal(0, 0.02 * rng.integers(0, 4), len(base))]
        else:
            vector, label = [float(np.float32(x)) for x in rng.normal(size=8)], int(rng.integers(0, 3))
        rows.append((i, vector, label))
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [None] * 8, 1), (1004, rows[0][1], None), (1005, [], 1), (1006, [2 * x for x in rows[0][1]], rows[0][2]), (1007, rows[0][1][:4], rows[0][2])]
    random.Random(3).shuffle(rows)
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = vectors.near_vectors(table, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_null_ids_repeated_rows_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, None, 1)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, schema)).collect())
    assert got == [("4", 2, "4", True), ("4", 2, "4", True), ("None", 0, "None", False), ("None", 2, "4", False)]
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0

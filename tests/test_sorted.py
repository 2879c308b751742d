"""Pages and indexes from a directory, compared with the operators on all rows."""

from __future__ import annotations

import random

import pytest

from sigtrail.operators import paging
from sigtrail.operators.filters import EntryFilter
from sigtrail.schema import ENTRY_SCHEMA
from sigtrail.sinks.sorted import INGEST, open_sorted, write_sorted

N, SIZE = 230, 120


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("ab"), rng.randrange(50) * 10, rng.choice(["d1", "d2", "d3"]), rng.choice(["x", "y"]), "", 3, None, None, None, rng.choice([None, None, "p", "q", ""])) for i in range(N)]
    return spark.createDataFrame(data, ENTRY_SCHEMA)


def ids(df):
    return [(r.source_id, r.id) for r in df.collect()]


@pytest.mark.parametrize("column", ["timestamp", "value"])
def test_every_page_and_index_like_the_operators(spark, rows, tmp_path, column):
    kept = write_sorted(rows, str(tmp_path / "s"), column, rows_per_file=30)
    assert len(kept.entries().inputFiles()) >= 6 and kept.total == N
    for direction in ("asc", "desc"):
        want = ids(paging.sort_entries(rows, column, direction))
        got = []
        for number in range(1, N // SIZE + 2):
            page, total = kept.page(number, SIZE, direction)
            assert total == N
            got += ids(page)
        assert got == want
        assert ids(kept.rows(33, 34, direction)) == want[33:34] and ids(kept.rows(-5, 10**9, direction)) == want and ids(kept.rows(N, N + 9, direction)) == []
        for t in (250, 491):
            assert kept.index_of_time(t, direction) == paging.index_of_time(rows, t, None, column, direction).first()[0]


def test_a_page_reads_few_files(spark, rows, tmp_path):
    kept = write_sorted(rows, str(tmp_path / "s"), "timestamp", rows_per_file=30)
    for number in (7, 15):
        assert len(kept.page(number, 15)[0].inputFiles()) <= 2
        assert len(kept.page(number, 15, "desc")[0].inputFiles()) <= 2
    assert open_sorted(spark, kept.path) == kept


def test_ingest_order(spark, rows, tmp_path):
    kept = write_sorted(rows, str(tmp_path / "s"), INGEST, rows_per_file=50)
    want = sorted(ids(rows))
    assert ids(kept.rows(100, 150)) == want[100:150] == ids(paging.entries_range(rows, 100, 150))
    at = {(r.source_id, r.id): r.ts_ms for r in rows.collect()}
    for t in (480, 500):
        for order, direction in ((want, "asc"), (want[::-1], "desc")):
            assert kept.index_of_time(t, direction) == next((i for i, k in enumerate(order) if at[k] >= t), -1)


def test_a_filter_is_answered_from_the_rows(spark, rows, tmp_path):
    kept = write_sorted(rows, str(tmp_path / "s"), "deviceId", rows_per_file=50)
    flt = EntryFilter(signal_names=("x",))
    page, total = kept.page(2, 20, "desc", flt)
    want, n = paging.page(rows, flt, "deviceId", "desc", 2, 20)
    assert (ids(page), total) == (ids(want), n)
    assert kept.index_of_time(300, "asc", flt) == paging.index_of_time(rows, 300, flt, "deviceId").first()[0]


def test_no_rows(spark, rows, tmp_path):
    kept = write_sorted(rows.limit(0), str(tmp_path / "s"))
    assert kept.total == 0 and kept.page()[0].count() == 0 and kept.index_of_time(0) == -1

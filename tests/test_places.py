"""Deep pages and places in the sorted table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from checks import paging as pages
from sigtrail.operators import paging
from sigtrail.plans import ordered
from sigtrail.schema import ENTRY_SCHEMA


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, "a", rng.randrange(40) * 10, rng.choice(["d1", "d2"]), "x", "", 3, None, None, None, rng.choice([None, "p", "q", ""])) for i in range(300)]
    return spark.createDataFrame(data, ENTRY_SCHEMA).repartition(5)


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("column", ["timestamp", "value", "dest"])
def test_deep_pages_sort_the_table_once(rows, monkeypatch, column, direction):
    want = [r["id"] for r in paging.sort_entries(rows, column, direction).collect()]
    written = []
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 0)
    monkeypatch.setattr(ordered, "cut_lineage", lambda df, write=ordered.cut_lineage: written.append(df) or write(df))
    got = pages.all_pages(rows, column, direction, count=7)
    assert len(written) == 1
    size = -(-300 // 7)
    assert {(r["page"], r["id"]) for r in got.collect()} == {(i // size, k) for i, k in enumerate(want)}
    page = paging.page_rows(rows, column, direction, 3, 50)
    assert [r["id"] for r in page.collect()] == want[100:150] and page.columns == rows.columns
    assert paging.page_rows(rows, column, direction, 9, 50).count() == 0


def test_equal_rows_are_on_one_page_each(rows, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 0)
    twice = rows.unionByName(rows)
    got = pages.all_pages(twice, "value").groupBy("id").count().filter(F.col("count") != 2)
    assert got.count() == 0


def test_value_at_a_place_without_the_rows_before_it(spark, rows):
    times = sorted(r["ts_ms"] for r in rows.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert [ordered.value_at(rows, "ts_ms", i) for i in (0, 151, 299)] == [times[i] for i in (0, 151, 299)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    late = rows.withColumn("ts_ms", F.when(F.col("id") > 0, F.col("ts_ms")))
    assert ordered.value_at(late, "ts_ms", 0) is None
    assert pages.late_time(rows) == times[296]


@pytest.mark.parametrize("query", ["index_of_time_null_keys", "directory_index_of_time"])
def test_times_are_not_taken_through_the_driver(spark, query, monkeypatch):
    """An offset into a sorted frame brings all rows before it to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    from tests.conftest import SMALL

    taken = []
    monkeypatch.setattr(DataFrame, "offset", lambda self, n, skip=DataFrame.offset: taken.append(n) or skip(self, n))
    pages.CHECKS[query].run(spark, SMALL).collect()
    assert taken == []

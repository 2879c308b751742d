"""Costly steps are taken once, and small files need no task each."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import CHECKS
from sigtrail.adapters import int_entries
from sigtrail.sinks import store
from sigtrail.sources import stocker
from tests.conftest import SMALL


def plan(df, kind: str) -> str:
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_small_files_share_a_task(spark, tmp_path):
    rows = int_entries(spark, SMALL)
    n = rows.count()
    cut = store._clustered(rows, 50)
    assert cut.rdd.getNumPartitions() == 1
    store.write_entries(rows, str(tmp_path / "s"), rows_per_file=50)
    back = spark.read.parquet(str(tmp_path / "s" / "entries"))
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == -(-n // 50) and max(sizes) == 50
    assert back.select("id").distinct().count() == n == back.count()
    span = F.max("ts_ms") - F.min("ts_ms")
    in_file = back.groupBy(F.input_file_name()).agg(span.alias("span")).agg(F.avg("span")).first()[0]
    assert in_file < 0.6 * rows.agg(span).first()[0]


def test_messages_are_parsed_once_for_transactions(spark):
    found = CHECKS["secs_transactions"].run(spark, SMALL)
    assert "FileScan text" not in plan(found, "executedPlan")


def test_items_bring_columns_of_their_message(spark):
    found = CHECKS["secs_items"].run(spark, SMALL)
    text = plan(found, "executedPlan")
    assert text.count("FileScan text") == 1 and "Join" not in text


def test_transfer_cells_are_read_once(spark):
    columns = [f"c{i}" for i in range(15)]
    rows = spark.createDataFrame([(1, *["2024-05-02 21:40:08"] * 15), (2, *["late"] * 15), (3, *[None] * 15)], "id long, " + ", ".join(f"{c} string" for c in columns))
    parsed = stocker.normalize_stk_transfer(rows.withColumn("c1", F.reverse(F.reverse("c1"))), "id", columns)
    assert plan(parsed.entries, "optimizedPlan").count("reverse(reverse(") == 1
    assert [(r["id"], r["ts_ms"]) for r in parsed.entries.collect()] == [(1, 1714686008000)]
    assert sorted(r["reason"] for r in parsed.errors.collect()) == ["invalid timestamp"] * 2

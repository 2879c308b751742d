"""Plan shapes that have to hold at scale, and the stores."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sigtrail.adapters import int_entries, rule_entries, transition_rules
from sigtrail.operators import asof, dims, merge, paging
from sigtrail.operators import transitions as tact
from sigtrail.operators.filters import EntryFilter, filter_entries
from sigtrail.session import is_small
from sigtrail.sinks import store
from sigtrail.streaming.ingest import stream_entries, streamed_entries
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    rows = int_entries(spark, SMALL)
    path = str(tmp_path / "store")
    store.write_entries(merge.merge_logs([rows, rows], ["a", "b"]), path)
    return path


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = stored(spark, tmp_path)
    store.write_entries(merge.merge_logs([int_entries(spark, SMALL)], ["c"]), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    entries = store.read_entries(spark, path, ["a"])
    text = plan(filter_entries(entries, EntryFilter(device_ids=("U1",), signal_names=("view",))))
    assert "EqualTo(device_id,U1)" in text or "In(device_id, [U1])" in text
    assert re.search(r"PartitionFilters: \[[^\]]*batch", text)
    assert {f.split("/")[-2] for f in entries.inputFiles()} == {"batch=0", "batch=1"} and entries.count() == int_entries(spark, SMALL).count()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(dims.signals(entries))).group(1)
    assert set(schema.split(",")) == {"source_id:string", "device_id:string", "signal:string"}
    assert "LessThanOrEqual(ts_ms,5)" in plan(asof.values_at(entries, 5))
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_one_shuffle_for_all_rules(spark):
    found = tact.transitions(rule_entries(spark, SMALL), transition_rules(spark, SMALL))
    main = plan(found).split("BroadcastExchange")[0]
    assert main.count("Exchange hashpartitioning(rule_id") == 1
    assert plan(found).count("SortMergeJoin") == 0


def test_latest_rows_are_aggregated_before_the_shuffle(spark):
    text = plan(asof.values_at(int_entries(spark, SMALL), 1_705_320_000_000))
    assert "partial_max_by" in text and "Window" not in text


def test_first_pages_are_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(paging.page_rows(int_entries(spark, SMALL), "timestamp", "asc", 2, 50))


def test_rules_past_the_broadcast_bound_give_the_same(spark):
    entries, rules = rule_entries(spark, SMALL), transition_rules(spark, SMALL)
    want = sorted(map(tuple, tact.transitions(entries, rules).collect()))
    spark.conf.set("spark.sigtrail.maxBroadcastRows", "1")
    try:
        assert not is_small(rules)
        assert sorted(map(tuple, tact.transitions(entries, rules).collect())) == want
    finally:
        spark.conf.unset("spark.sigtrail.maxBroadcastRows")


def test_hot_keys_are_cut_on_their_own(spark):
    entries = int_entries(spark, SMALL)
    want = sorted(r["id"] for r in paging.changed_only(entries).collect())
    spark.conf.set("spark.sigtrail.maxRowsPerTask", "5")
    try:
        cut = paging.changed_only(entries)
        assert "_segment" in plan(cut)
        assert sorted(r["id"] for r in cut.collect()) == want
    finally:
        spark.conf.unset("spark.sigtrail.maxRowsPerTask")


def test_store_replaces_skips_and_removes(spark, tmp_path):
    path = stored(spark, tmp_path)
    rows = int_entries(spark, SMALL)
    n = rows.count()
    store.write_entries(merge.merge_logs([rows.filter("signal = 'view'")], ["b"]), path)
    views = rows.filter("signal = 'view'").count()
    assert store.read_entries(spark, path).count() == n + views
    store.write_new_sources(merge.merge_logs([rows, rows], ["b", "c"]), path)
    assert store.read_entries(spark, path).count() == n + views + n
    known = spark.createDataFrame([("a",), ("b",)], "source_id string")
    assert [r[0] for r in store.orphan_sources(spark, path, known).collect()] == ["c"]
    assert store.remove_orphans(spark, path, known) == 1
    assert {r[0] for r in store.stored_sources(spark, path).collect()} == {"a", "b"}
    fresh = str(tmp_path / "fresh")
    store.write_new_sources(merge.merge_logs([rows], ["a"]), fresh)
    assert store.read_entries(spark, fresh).count() == n


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        stream_entries(spark, str(folder), "generic_log", target, state).awaitTermination()
        return sorted(r["val_str"] for r in streamed_entries(spark, target).collect())

    (folder / "a.log").write_text("2023-10-27 10:20:30 [L] one\n2023-10-27 10:20:31 [L] two\n")
    assert run() == ["one", "two"]
    (folder / "b.log").write_text("2023-10-27 10:20:32 [L] three\n2023-99-27 10:20:32 [L] bad\n")
    assert run() == ["one", "three", "two"]
    assert run() == ["one", "three", "two"]
    assert spark.read.parquet(f"{target}/errors").filter(F.col("reason") == "invalid timestamp").count() == 1

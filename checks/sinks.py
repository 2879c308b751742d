"""Results are written, read back and compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ingest import _DEBUG_SQL, plain, plc_debug_line, rendered
from checks.merge import _sources, overlapping
from checks.registry import EV, check
from checks.transitions import FOUND, found
from sigtrail.adapters import int_entries
from sigtrail.session import scratch_path
from sigtrail.sinks import store, text
from sigtrail.streaming.ingest import stream_entries, streamed_entries

_ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


@check(f"WITH {_sources('k', 'signal')} SELECT source_id, id, ts_ms, device_id, signal, v FROM m WHERE source_id IN ('a', 'c')")
def stored_entries(spark, sf):
    """Three sources are kept; one is written again in place and one is removed as an orphan."""
    path = scratch_path(spark, "store")
    rows = overlapping(spark, sf, int_entries)
    store.write_entries(rows, path)
    store.write_entries(rows.filter("source_id = 'c'"), path)
    store.write_new_sources(rows.filter("source_id = 'a'"), path)
    store.remove_orphans(spark, path, spark.createDataFrame([("a",), ("c",)], "source_id string"))
    back = store.read_entries(spark, path)
    return back.select("source_id", "id", "ts_ms", "device_id", "signal", F.col("val_int").alias("v"))


@check(f"WITH {_sources('k', 'signal')} SELECT source_id, id, ts_ms, device_id, signal, v FROM m WHERE signal = 'view' AND source_id <> 'b'")
def stored_entries_compacted(spark, sf):
    """Many files per batch, a source written twice and one removed, then merged."""
    path = scratch_path(spark, "store")
    rows = overlapping(spark, sf, int_entries)
    store.write_entries(rows.filter("source_id <> 'c'"), path, rows_per_file=1000)
    store.write_entries(rows.filter("source_id = 'c' AND id % 2 = 0"), path)
    store.write_entries(rows.filter("source_id = 'c'"), path)
    store.remove_orphans(spark, path, spark.createDataFrame([("a",), ("c",)], "source_id string"))
    store.compact(spark, path, rows_per_file=1000)
    back = store.read_entries(spark, path).filter("signal = 'view'")
    return back.select("source_id", "id", "ts_ms", "device_id", "signal", F.col("val_int").alias("v"))


def _transitions_back(spark, sf, fmt, sep):
    path = scratch_path(spark, fmt)
    text.write_transitions(found(spark, sf)[0], path, fmt)
    back = spark.read.option("sep", sep).option("header", True).csv(path)
    return back.toDF("start_time", "end_time", "duration", "status")


_WRITTEN = f"{FOUND} SELECT {_ISO.format('start_ms')} AS start_time, {_ISO.format('end_ms')} AS end_time, CAST(duration_ms AS VARCHAR) AS duration, status FROM found"


@check(_WRITTEN)
def transitions_csv(spark, sf):
    return _transitions_back(spark, sf, "csv", ",")


@check(_WRITTEN)
def transitions_tsv(spark, sf):
    return _transitions_back(spark, sf, "tsv", "\t")


@check(f"WITH {EV} SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS time, device_id, signal, CAST(k AS VARCHAR) AS value FROM ev")
def entries_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    text.write_entries_tsv(int_entries(spark, sf), path)
    return spark.read.option("sep", "\t").csv(path).toDF("time", "device_id", "signal", "value")


@check(f"WITH {EV} SELECT id, ts_ms, device_id, signal, category, k AS val_int FROM ev")
def entries_json(spark, sf):
    path = scratch_path(spark, "json")
    text.write_entries_json(int_entries(spark, sf), path)
    schema = "id long, ts_ms long, device_id string, signal string, category string, val_int long"
    return spark.read.schema(schema).json(path)


@check(_DEBUG_SQL)
def stream_ingest(spark, sf):
    """The folder is read as a stream, in small batches, into a store."""
    source, target = rendered(spark, sf, plc_debug_line, "stream"), scratch_path(spark, "streamed")
    query = stream_entries(
        spark, source, "plc_debug", target, scratch_path(spark, "checkpoint"), max_files_per_batch=1
    )
    query.awaitTermination()
    return plain(streamed_entries(spark, target))

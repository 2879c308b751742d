"""Incremental ingest: new log files in a folder become rows of the entries store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigtrail.operators.resolve import apply_types, merge_type_states, type_state
from sigtrail.schema import ENTRY_SCHEMA
from sigtrail.session import cut_lineage
from sigtrail.sinks.store import read_entries, write_entries
from sigtrail.sources.ingest import PARSERS, RESOLVING
from sigtrail.sources.lines import locate, number_lines


def _append(frame: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch: a batch that is replayed replaces itself."""
    (
        frame.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def stream_entries(
    spark: SparkSession,
    directory: str,
    fmt: str,
    store: str,
    checkpoint: str,
    max_files_per_batch: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Parse files as they appear, with the expressions of the batch readers.

    Rows go to a store (see ``sinks.store``) with a batch for each micro-batch, rejected
    lines to ``store``/errors.  A file is read by one micro-batch, so a source is in one
    batch, and ``compact(..., named=True)`` merges small ones.  By default everything
    that is there is taken and the query ends.  Rows are stored as parsed.  A signal's type
    depends on all of its rows, also on those still to come, so each micro-batch adds
    what it knows of types to ``store``/types, and reading settles them.
    """
    parse, line_sep = PARSERS[fmt]
    reader = spark.readStream.option("lineSep", line_sep)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse(number_lines(batch))
        write_entries(parsed.entries, store, batch_id)
        _append(parsed.errors, f"{store}/errors", batch_id)
        if fmt in RESOLVING:
            # From the rows just stored, so that the text isn't parsed again.
            stored = spark.read.schema(ENTRY_SCHEMA).parquet(f"{store}/entries/batch={batch_id}")
            _append(type_state(stored), f"{store}/types", batch_id)

    return (
        locate(reader.text(directory))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


_STATE = "source_id string, device_id string, signal string, seen int, last struct<id: bigint, kind: string>, batch_id long"


def streamed_entries(spark: SparkSession, store: str, fmt: str | None = None) -> DataFrame:
    """Stored rows; with ``fmt`` each signal has the one type that all rows so far settle.

    Types come from the states of the micro-batches, a row per signal and batch; no row
    of the log is read to find them.
    """
    rows = read_entries(spark, store)
    return apply_types(rows, streamed_types(spark, store), RESOLVING[fmt]) if fmt in RESOLVING else rows


def streamed_types(spark: SparkSession, store: str) -> DataFrame:
    """State of each signal's type after all micro-batches so far."""
    return merge_type_states(spark.read.schema(_STATE).parquet(f"{store}/types"))


def compact_types(spark: SparkSession, store: str) -> None:
    """Merge the states of micro-batches before the latest one, which may be replayed.

    A merged state may be counted twice without harm, so readers and a compaction that
    breaks off see right types throughout.
    """
    path = f"{store}/types"
    states = spark.read.schema(_STATE).parquet(path)
    latest, merged_before = states.agg(F.max("batch_id"), F.min("batch_id")).first()
    if latest is None or latest <= 0:
        return
    fresh = min(merged_before, 0) - 1  # merged states have negative numbers
    _append(cut_lineage(merge_type_states(states.filter(F.col("batch_id") < latest))), path, fresh)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    system = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in system.listStatus(fs_path(path)):
        name = folder.getPath().getName()
        if name.startswith("batch_id=") and fresh < int(name.removeprefix("batch_id=")) < latest:
            system.delete(folder.getPath(), True)

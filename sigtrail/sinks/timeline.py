"""Entries kept by time, with the state of every signal at regular times.

A timeline holds the rows of each time interval in a folder of their own, and for each
interval two snapshots: the last row of every signal before it and the first row of every
signal after it.  A question about a time reads one snapshot and one interval, about a
window its intervals and two snapshots, however long the history is.

``upto`` and ``around`` give those rows as an ordinary entries frame.  Operators that
look at the last row before a time, the rows of a window or the first row after it
(``values_at``, ``values_at_times``, ``boundary_values``, ``chunk_with_lead_in``,
``state_intervals``, ``unit_status``, ``carrier_locations`` and the rest) return on it
what they return on all entries.

Intervals without rows have no folder and no snapshot.  Snapshots have a row per signal
and interval, so intervals should be long enough to hold several rows of most signals;
``fitting_interval`` proposes a length for a share of extra rows.

    <path>/entries/slot=<number of the interval>/batch=<append>
    <path>/before, <path>/after/interval=<place in the order of intervals>/batch=<append>
    <path>/intervals/batch=<append>           written last, so it commits an append
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtrail.plans.ordered import position
from sigtrail.schema import ENTRY_COLUMNS, ENTRY_SCHEMA, SIGNAL_KEY, TIME_ORDER
from sigtrail.session import cut_lineage, is_small

_INTERVALS = "slot long, interval long, rows long, interval_ms long, batch int"
_ROWS_PER_FILE = 20_000_000
_MOST_PATHS = 256
"""Interval folders that a read names one by one; more are pruned from a listing."""


def _slot(interval_ms: int, t: Column | int) -> Column:
    return F.floor((t if isinstance(t, Column) else F.lit(t)) / F.lit(interval_ms)).cast("long")


def fitting_interval(entries: DataFrame, share: float = 0.1) -> int:
    """Milliseconds per interval for which a kind of snapshot adds about ``share`` of the rows."""
    signals = entries.groupBy(*SIGNAL_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    count, rows, low, high = signals.agg(F.count(F.lit(1)), F.sum("n"), F.min("lo"), F.max("hi")).first()
    if not count:
        return 1
    return max(1, -(-(high - low + 1) // max(1, int(rows * share / count))))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _write(df: DataFrame, path: str, *folders: str) -> None:
    order = [*folders, *SIGNAL_KEY, "ts_ms", "source_id", "id"]
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", _ROWS_PER_FILE)
        .partitionBy(*folders, "batch")
        .parquet(path)
    )


class Timeline(NamedTuple):
    spark: SparkSession
    path: str
    interval_ms: int
    batches: int

    @property
    def intervals(self) -> DataFrame:
        """``slot, interval, rows`` of each interval that has rows, in order of time."""
        return self.spark.read.schema(_INTERVALS).parquet(f"{self.path}/intervals").select("slot", "interval", "rows")

    def _at(self, t_ms: int) -> tuple[int, int | None]:
        """Place and slot of the last interval that begins at or before a time."""
        begun = self.intervals.where(F.col("slot") <= _slot(self.interval_ms, t_ms))
        found = begun.agg(F.max("interval"), F.max("slot")).first()
        return (-1, None) if found[0] is None else (found[0], found[1])

    def _read(self, kind: str, folder: str, values: list[int]) -> DataFrame:
        root = f"{self.path}/{kind}"
        paths = [p for v in values if _exists(self.spark, p := f"{root}/{folder}={v}")]
        if not paths:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        found = self.spark.read.schema(f"{ENTRY_SCHEMA.toDDL()}, {folder} long, batch int").option("basePath", root).parquet(*paths)
        return found.where(F.col("batch") < self.batches).select(*ENTRY_COLUMNS)

    def entries(self, first_slot: int | None = None, last_slot: int | None = None) -> DataFrame:
        """Rows of the intervals from one slot to another, both included."""
        between = self.intervals
        if first_slot is not None:
            between = between.where(F.col("slot") >= first_slot)
        if last_slot is not None:
            between = between.where(F.col("slot") <= last_slot)
        named = [r.slot for r in between.select("slot").limit(_MOST_PATHS + 1).collect()]
        if len(named) <= _MOST_PATHS:
            return self._read("entries", "slot", sorted(named))
        every = self.spark.read.schema(f"{ENTRY_SCHEMA.toDDL()}, slot long, batch int").parquet(f"{self.path}/entries").where(F.col("batch") < self.batches)
        if first_slot is not None:
            every = every.where(F.col("slot") >= first_slot)
        if last_slot is not None:
            every = every.where(F.col("slot") <= last_slot)
        return every.select(*ENTRY_COLUMNS)

    def upto(self, t_ms: int) -> DataFrame:
        """Rows among which the last one of every signal at or before ``t_ms`` is."""
        interval, slot = self._at(t_ms)
        if slot is None:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self._read("before", "interval", [interval]).unionByName(self.entries(slot, slot))

    def around(self, start_ms: int, end_ms: int) -> DataFrame:
        """All rows of ``[start, end]``, and rows among which the last one of every signal
        before the window and the first one after it are."""
        first, first_slot = self._at(start_ms)
        last, last_slot = self._at(end_ms)
        rows = self._read("after", "interval", [last])
        if last_slot is not None:
            rows = rows.unionByName(self.entries(first_slot, last_slot))
        return rows if first_slot is None else rows.unionByName(self._read("before", "interval", [first]))


def open_timeline(spark: SparkSession, path: str) -> Timeline:
    last = spark.read.schema(_INTERVALS).parquet(f"{path}/intervals").agg(F.max("interval_ms"), F.max("batch")).first()
    return Timeline(spark, path, last[0], last[1] + 1)


def append_timeline(entries: DataFrame, path: str, interval_ms: int | None = None) -> Timeline:
    """Add rows that are later than all intervals stored so far; creates the timeline.

    Snapshots of new intervals are carried on from the last state, and signals that had
    no later row so far get one in the snapshots after older intervals.  Nothing that is
    stored is rewritten.  An append that fails half way is invisible, and the next one
    replaces its files.  Rows of an interval that is stored already are refused, so
    append whole intervals.  Without rows nothing changes.
    """
    spark = entries.sparkSession
    old = open_timeline(spark, path) if _exists(spark, f"{path}/intervals") else None
    step = old.interval_ms if old else interval_ms or fitting_interval(entries)
    batch = old.batches if old else 0
    slot = _slot(step, F.col("ts_ms"))
    rows = entries.select(*ENTRY_COLUMNS, slot.alias("slot"), F.lit(batch).alias("batch"))
    if old:
        # Files of an append that was never committed must not mix with this one's.
        for kind in ("entries", "before", "after"):
            _drop_batch(spark, f"{path}/{kind}", batch)
    _write(rows, f"{path}/entries", "slot")
    here = spark.read.schema(f"{ENTRY_SCHEMA.toDDL()}, slot long, batch int").parquet(f"{path}/entries").where(F.col("batch") == batch)
    counts = cut_lineage(here.groupBy("slot").agg(F.count(F.lit(1)).alias("rows")))
    if not counts.limit(1).count():
        if old:
            return old
        raise ValueError("a timeline begins with at least one row")
    stored, newest = old.intervals.agg(F.count(F.lit(1)), F.max("slot")).first() if old else (0, None)
    if old and counts.agg(F.min("slot")).first()[0] <= newest:
        _drop_batch(spark, f"{path}/entries", batch)
        raise ValueError(f"rows before {(newest + 1) * step} ms belong to intervals that are stored")
    numbered = position(counts, [], ["slot"], "interval").withColumn("interval", F.col("interval") + stored)
    added = cut_lineage(numbered.select("slot", "interval", "rows", F.lit(step).cast("long").alias("interval_ms")))
    before, after = _snapshots(here, added, old, stored)
    tagged = F.lit(batch).alias("batch")
    _write(before.select("*", tagged), f"{path}/before", "interval")
    _write(after.select("*", tagged), f"{path}/after", "interval")
    added.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/intervals")
    return open_timeline(spark, path)


def _drop_batch(spark: SparkSession, root: str, batch: int) -> None:
    conf = spark._jsc.hadoopConfiguration()
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/batch={batch}")
    fs = pattern.getFileSystem(conf)
    for found in fs.globStatus(pattern) or []:
        fs.delete(found.getPath(), True)


def _snapshots(rows: DataFrame, added: DataFrame, old: Timeline | None, stored: int) -> tuple[DataFrame, DataFrame]:
    """Rows before and after each interval that an append adds to.

    A signal's last row of an interval is in force before all later intervals up to the
    next one that has rows of the signal; its first row comes after all earlier ones
    back to the previous one.
    """
    row, when = F.struct(*[c for c in ENTRY_COLUMNS if c not in SIGNAL_KEY]), F.struct(*TIME_ORDER)
    order = added.select("slot", "interval")
    edges = rows.groupBy(*SIGNAL_KEY, "slot").agg(F.min_by(row, when).alias("first"), F.max_by(row, when).alias("last"))
    marks = edges.join(F.broadcast(order) if is_small(order) else order, "slot").select(*SIGNAL_KEY, "interval", "first", "last")
    if old:
        state = old.upto((1 << 62)).groupBy(*SIGNAL_KEY).agg(F.max_by(row, when).alias("last"))
        known = old.intervals.select("slot", "interval")
        placed = state.withColumn("slot", _slot(old.interval_ms, F.col("last.ts_ms"))).join(F.broadcast(known) if is_small(known) else known, "slot")
        marks = marks.unionByName(placed.select(*SIGNAL_KEY, "interval", F.lit(None).cast(edges.schema["first"].dataType).alias("first"), "last"))
    # As many rows of a signal as there are intervals, at most.
    by_time = Window.partitionBy(*SIGNAL_KEY).orderBy("interval")
    linked = marks.withColumns({"next": F.lead("interval").over(by_time), "previous": F.lag("interval").over(by_time)})
    last = added.agg(F.max("interval")).first()[0]
    since, until = F.greatest(F.col("interval") + 1, F.lit(stored)), F.coalesce("next", F.lit(last))
    columns = [c if c in SIGNAL_KEY else F.col(f"row.{c}") for c in ENTRY_COLUMNS]
    before = linked.where(since <= until).select(*SIGNAL_KEY, F.col("last").alias("row"), F.explode(F.sequence(since, until)).alias("at"))
    after = linked.where("first IS NOT NULL").select(*SIGNAL_KEY, F.col("first").alias("row"), F.explode(F.sequence(F.coalesce("previous", F.lit(-1)), F.col("interval") - 1)).alias("at"))
    return tuple(df.select(*columns, F.col("at").alias("interval")) for df in (before, after))

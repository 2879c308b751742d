"""Keeping entries as Parquet, clustered by signal and time.

A write is a batch.  Its rows, of however many sources, are laid out along a Z-order
curve over (signal, time): a file holds a rectangle of both, so a filter on the signal
alone and one on the time alone each skip most files by their bounds.  Small batches
are one file.  Bloom filters on device, signal and source skip row groups whose bounds
are wide.

A table of sources says in which batch the rows of a source are; the latest batch wins,
so writing a source again replaces it without touching its old rows.  That table is
written after the rows and commits them.  ``compact`` merges small batches and drops
replaced rows.  One writer at a time; readers may read throughout, except for files that
a compaction deletes.

    <path>/entries/batch=<n>
    <path>/sources/batch=<n>      source_id, rows; -1 for a source that is removed
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sigtrail.plans.ordered import OrderedRows, count_not_above
from sigtrail.schema import ENTRY_COLUMNS, ENTRY_SCHEMA, SIGNAL_KEY
from sigtrail.session import cut_lineage, drop_stage, is_small

ROWS_PER_FILE = 10_000_000
ROWS_PER_TASK = 250_000
"""A task writes several smaller files up to these rows, as each task costs the driver a
sample of its bounds and a report."""
_MOST_BITS = 10
_ROWS = StructType([*ENTRY_SCHEMA.fields, StructField("batch", IntegerType())])
_SOURCES = "source_id string, rows long, batch int"
_BLOOMS = {f"parquet.bloom.filter.enabled#{c}": "true" for c in (*SIGNAL_KEY, "source_id")}


def _z_value(columns: list[Column], bits: int) -> Column:
    """Bits of the columns in turn, the highest first."""
    z = F.lit(0).cast("long")
    for bit in range(bits):
        for i, c in enumerate(columns):
            place = bit * len(columns) + len(columns) - 1 - i
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), bit).bitwiseAND(F.lit(1)), place))
    return z


def _clustered(rows: DataFrame, rows_per_file: int) -> DataFrame:
    """``rows`` dealt to files by place on the curve and sorted inside them.

    Both axes are cut at equal numbers of rows, so cells are about equally full.
    """
    inside = [*SIGNAL_KEY, "ts_ms", "source_id", "id"]
    total = rows.count()
    files = -(-total // rows_per_file)
    if files <= 1:
        return rows.coalesce(1).sortWithinPartitions(*inside)
    bits = min(_MOST_BITS, max(1, ((4 * files - 1).bit_length() + 1) // 2))
    cells = 1 << bits
    counted = rows.groupBy(*SIGNAL_KEY).agg(F.count(F.lit(1)).alias("n"))
    upto = OrderedRows(counted, [], SIGNAL_KEY).running_total({"upto": F.col("n")}).frame()
    signals = upto.select(*SIGNAL_KEY, F.floor((F.col("upto") - F.col("n")) * cells / F.lit(total)).cast("int").alias("_signal"))
    cuts = rows.approxQuantile("ts_ms", [i / cells for i in range(1, cells)], 1 / (8 * cells))
    time = count_not_above(F.array(*[F.lit(c).cast("long") for c in cuts]), len(cuts), F.col("ts_ms"))
    placed = rows.join(F.broadcast(signals) if is_small(signals) else signals, SIGNAL_KEY)
    tasks = -(-total // max(rows_per_file, ROWS_PER_TASK))
    dealt = placed.withColumn("_z", _z_value([F.col("_signal"), time], bits)).repartitionByRange(tasks, "_z", *inside)
    if rows_per_file >= ROWS_PER_TASK:
        return dealt.sortWithinPartitions(*inside).drop("_signal", "_z")
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    cut = dealt.sortWithinPartitions("_z", *inside).withColumn("_file", F.floor(in_task / rows_per_file))
    return cut.sortWithinPartitions("_file", *inside).drop("_signal", "_z", "_file")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = _path(spark, path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = _path(spark, path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _sources(spark: SparkSession, path: str) -> DataFrame:
    """All batches of all sources, with the latest of each source as ``live``."""
    known = spark.read.schema(_SOURCES).parquet(f"{path}/sources")
    latest = known.groupBy("source_id").agg(F.max("batch").alias("live"))
    return known.join(latest, "source_id")


def _commit(sources: DataFrame, path: str, batch: int) -> None:
    sources.select("source_id", "rows").write.mode("overwrite").parquet(f"{path}/sources/batch={batch}")


def _next_batch(spark: SparkSession, path: str) -> int:
    if not _exists(spark, f"{path}/sources"):
        return 0
    last = spark.read.schema(_SOURCES).parquet(f"{path}/sources").agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def write_entries(entries: DataFrame, path: str, batch: int | None = None, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Replace the stored rows of every source in ``entries``; others stay.

    ``batch`` names the batch to write, so that a repeated write replaces itself; a
    source should then be in one named batch only.  By default it is a new one, and
    nothing is written without rows.
    """
    spark = entries.sparkSession
    rows = cut_lineage(entries.select(*ENTRY_COLUMNS))
    if batch is not None or rows.limit(1).count():
        number = _next_batch(spark, path) if batch is None else batch
        (
            _clustered(rows, rows_per_file)
            .write.mode("overwrite")
            .options(**_BLOOMS)
            # Files of one task each have a size that is estimated; others are cut exactly.
            .option("maxRecordsPerFile", rows_per_file if rows_per_file < ROWS_PER_TASK else 2 * rows_per_file)
            .parquet(f"{path}/entries/batch={number}")
        )
        _commit(rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows")), path, number)
    drop_stage(rows)


def read_entries(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Stored entries, of all or of the given sources.  Filters on signal, device, source
    and time reach the files."""
    known = _sources(spark, path)
    last = known.agg(F.max("batch")).first()[0]
    stored = spark.read.schema(_ROWS).parquet(f"{path}/entries").filter(F.col("batch") <= last)
    if sources is not None:  # only their batches are opened
        own = known.filter(F.col("source_id").isin(sources) & F.expr("batch = live")).agg(F.collect_set("batch")).first()[0]
        stored = stored.filter(F.col("batch").isin(own) & F.col("source_id").isin(sources))
    replaced = known.filter("batch < live").select("source_id", "batch")
    if replaced.limit(1).count():
        stored = stored.join(F.broadcast(replaced) if is_small(replaced) else replaced, ["source_id", "batch"], "left_anti")
    return stored.select(*ENTRY_COLUMNS)


def stored_sources(spark: SparkSession, path: str) -> DataFrame:
    return _sources(spark, path).filter("batch = live AND rows > 0").select("source_id")


def orphan_sources(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Stored sources that are not in ``known`` (a ``source_id`` frame)."""
    return stored_sources(spark, path).join(known.select("source_id"), "source_id", "left_anti")


def write_new_sources(entries: DataFrame, path: str) -> None:
    """Store only sources that are not stored yet; a stored file is not written twice."""
    try:
        have = stored_sources(entries.sparkSession, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        entries = entries.join(have, "source_id", "left_anti")
    write_entries(entries, path)


def remove_orphans(spark: SparkSession, path: str, known: DataFrame) -> int:
    """Remove stored sources that are not in ``known``; returns how many.

    Their rows are hidden at once and leave the disk with their batch or by ``compact``.
    """
    gone = cut_lineage(orphan_sources(spark, path, known).select("source_id", F.lit(-1).cast("long").alias("rows")))
    number = gone.count()
    if number:
        _commit(gone, path, _next_batch(spark, path))
        _drop_dead(spark, path)
    return number


def _drop_dead(spark: SparkSession, path: str) -> None:
    """Delete the rows of batches that no source is in any more."""
    alive = _sources(spark, path).groupBy("batch").agg(F.count_if(F.expr("batch = live AND rows > 0")).alias("n"), F.max("rows").alias("rows"))
    for row in alive.filter("n = 0 AND rows > 0").toLocalIterator():
        _delete(spark, f"{path}/entries/batch={row['batch']}")


def compact(
    spark: SparkSession, path: str, small_rows: int = ROWS_PER_FILE, rows_per_file: int = ROWS_PER_FILE, named: bool = False
) -> int:
    """Merge batches of fewer than ``small_rows`` rows, and those of which half the rows
    are replaced, into one; returns how many were merged.

    The merged batch is committed before the old ones are deleted, so a compaction that
    breaks off loses nothing.  ``named`` says that batches are named by their writer: the
    latest may be written again and stays, and merged ones get negative numbers, below
    any name.
    """
    known = _sources(spark, path).filter("rows > 0")
    in_force = F.sum(F.when(F.col("batch") == F.col("live"), F.col("rows")))
    per_batch = known.groupBy("batch").agg(F.sum("rows").alias("rows"), F.coalesce(in_force, F.lit(0)).alias("live_rows"))
    first, last = known.agg(F.min("batch"), F.max("batch")).first()
    chosen = per_batch.filter((F.col("live_rows") < small_rows) | (2 * F.col("live_rows") < F.col("rows")))
    chosen = cut_lineage(chosen.filter(F.col("batch") < last) if named and last is not None else chosen)
    number, rows, live_rows = chosen.agg(F.count(F.lit(1)), F.sum("rows"), F.sum("live_rows")).first()
    if number == 0 or (number == 1 and rows == live_rows):
        return 0
    if live_rows:
        moved = _sources(spark, path).filter("batch = live AND rows > 0").select("source_id", "batch").join(chosen.select("batch"), "batch")
        stored = spark.read.schema(_ROWS).parquet(f"{path}/entries").join(F.broadcast(chosen.select("batch")), "batch", "left_semi")
        kept = stored.join(F.broadcast(moved) if is_small(moved) else moved, ["source_id", "batch"], "left_semi")
        write_entries(kept, path, min(first, 0) - 1 if named else _next_batch(spark, path), rows_per_file)
    for row in chosen.toLocalIterator():
        _delete(spark, f"{path}/entries/batch={row['batch']}")
        _delete(spark, f"{path}/sources/batch={row['batch']}")
    drop_stage(chosen)
    return number

"""Which format a file has, from the share of matching lines at its start."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtrail.functions.text import is_blank, item, strip_bom, trim_space
from sigtrail.plans.stages import bind
from sigtrail.sources.backtick import (
    TRANSFER_MIN_FIELDS,
    clean_observable,
    is_observable_header,
    is_observable_line,
)
from sigtrail.sources.generic import GENERIC_LINE
from sigtrail.sources.lines import number_lines, scan_text
from sigtrail.sources.mcs import MCS_LINE
from sigtrail.sources.plc import CSV_SIGNAL_LINE, PLC_DEBUG_LINE, PLC_TAB_LINE
from sigtrail.sources.secs import SECS_HEADER

# Lines looked at, and the share that has to match.
_SHORT, _LONG = 10, 20
_MOST, _HALF = 0.6, 0.5


def _share(matches: Column, rank: Column, lines: int, least: float) -> Column:
    looked_at = F.when(rank <= lines, matches.cast("int"))
    return F.coalesce(F.avg(looked_at) >= least, F.lit(False))


HEAD_LINES = 256
"""Lines of a file that are looked at to find its first written ones."""
_BLOCK, _MOST_BYTES = 1 << 16, 1 << 22
_HEAD = "source_id string, id long, line string"


def read_head(uri: str, lines: int = HEAD_LINES) -> tuple[list[str], int]:
    """First lines of a file that aren't blank, and the bytes read for them.

    Reads block by block and stops as soon as it has enough; compressed files are
    recognised by their suffix.
    """
    system, path = fs.FileSystem.from_uri(uri)
    found: list[str] = []
    rest, used = b"", 0
    with system.open_input_stream(path) as stream:
        while len(found) < lines and used < _MOST_BYTES:
            block = stream.read(_BLOCK)
            used += len(block)
            *whole, rest = (rest + block).split(b"\n")
            if not block and rest:
                whole.append(rest)
            found += [x.removesuffix(b"\r").decode("utf-8", "replace") for x in whole if x.strip()]
            if not block:
                break
        else:
            if not found and rest:  # one very long line
                found = [rest.decode("utf-8", "replace")]
    return found[:lines], used


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            found, _ = read_head(uri)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())],
                names=["source_id", "id", "line"],
            )


def head_lines(spark: SparkSession, paths) -> DataFrame:
    """``source_id, id, line`` of the first lines of every file.

    Files are listed and dealt to tasks by Spark; a task opens each of its files and
    reads its first blocks, whatever its size.  On a file system that only Spark can
    read, the lines come from the first split of each file instead.
    """
    names = list(paths) if isinstance(paths, (list, tuple)) else [paths]
    files = spark.read.format("binaryFile").load(names).select(F.col("_metadata.file_path").alias("source_id"))
    first = files.limit(1).first()
    if first is None or _opens(first["source_id"]):
        return files.mapInArrow(_heads, _HEAD)
    return number_lines(scan_text(spark, paths).filter(F.col("block_start") == 0)).select("source_id", "id", "line")


def _opens(uri: str) -> bool:
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def detect_format(spark: SparkSession, paths) -> DataFrame:
    """``source_id, format`` per file; ``format`` is NULL where nothing fits.

    Files without a written line are left out.
    """
    cleaned = clean_observable(F.col("line"))
    lines = bind(
        head_lines(spark, paths),
        filled=~is_blank(F.col("line")),
        clean=F.when((cleaned != "") & ~is_observable_header(cleaned), cleaned),
    )
    before = Window.partitionBy("source_id").orderBy("id")
    ranked_lines = lines.withColumns(
        {
            "rank": F.when(F.col("filled"), F.sum(F.col("filled").cast("int")).over(before)),
            "clean_rank": F.when(F.col("clean").isNotNull(), F.count("clean").over(before)),
        }
    ).filter((F.col("rank") <= _LONG) | (F.col("clean_rank") <= _LONG))
    text = trim_space(F.col("line"))
    rank = F.col("rank")
    transfer = F.split(text, "`")
    secs = F.startswith(text, F.lit("@")) & F.rlike(text, F.lit(SECS_HEADER))
    joined = ranked_lines.groupBy("source_id").agg(
        F.max(rank).alias("_written"),
        _share(F.rlike(strip_bom(text), F.lit(PLC_DEBUG_LINE)), rank, _SHORT, _MOST).alias("plc_debug"),
        _share(F.rlike("line", F.lit(PLC_TAB_LINE)), rank, _SHORT, _MOST).alias("plc_tab"),
        _share(F.rlike(text, F.lit(MCS_LINE)), rank, _SHORT, _MOST).alias("mcs_log"),
        _share(F.rlike(text, F.lit(CSV_SIGNAL_LINE)), rank, _SHORT, _MOST).alias("csv_signal"),
        F.bool_or((rank <= _LONG) & secs).alias("secs_log"),
        _share(F.rlike(text, F.lit(GENERIC_LINE)), rank, _LONG, _HALF).alias("generic_log"),
        _share(
            (F.size(transfer) >= TRANSFER_MIN_FIELDS) & (item(transfer, 1) == "TRS"), rank, _LONG, _MOST
        ).alias("trs_log"),
        _share(is_observable_line(F.col("clean")), F.col("clean_rank"), _LONG, _MOST).alias("observable_log"),
    ).filter("_written > 0")
    ranked = [
        "plc_debug", "plc_tab", "mcs_log", "observable_log",
        "csv_signal", "secs_log", "generic_log", "trs_log",
    ]
    return joined.select(
        "source_id", F.coalesce(*[F.when(F.col(n), F.lit(n)) for n in ranked]).alias("format")
    )

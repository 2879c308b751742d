"""Log lines as rows, and the shape every text format returns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.plans.stages import bind
from sigtrail.schema import ENTRY_COLUMNS, VALUE_COLUMNS

# Low bits of ``id`` number the entries one line expands to.
ENTRY_BITS = 18


class ParsedLog(NamedTuple):
    """Two views of one classified frame: the typed rows and the rejected lines."""

    entries: DataFrame
    errors: DataFrame


def scan_text(spark: SparkSession, paths, line_sep: str = "\n") -> DataFrame:
    """Text records with the place they come from, before any ordering."""
    reader = spark.read.option("lineSep", line_sep)
    return locate(reader.text(list(paths) if isinstance(paths, (list, tuple)) else paths))


def locate(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("value"),
    )


def number_lines(located: DataFrame) -> DataFrame:
    """``id`` that follows line order inside a file and is unique there.

    A split starts at byte ``block_start`` and a line takes at least one byte,
    so ``block_start`` plus the row number inside the scan task grows along the
    file.  No global numbering and no shuffle is involved.
    """
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)"))
    return located.select(
        F.shiftleft(F.col("block_start") + row_in_task, ENTRY_BITS).alias("id"),
        "source_id",
        F.coalesce(line, F.col("value")).alias("line"),
    )


def read_lines(spark: SparkSession, paths) -> DataFrame:
    return number_lines(scan_text(spark, paths))


def extract(lines: DataFrame, **fields: Column) -> DataFrame:
    """Cut fields out of each line, once per line."""
    return bind(lines, **fields).select("id", "source_id", "line", *fields)


def split_result(classified: DataFrame) -> ParsedLog:
    """Entries and errors of a frame that has ``reason``, ``ts_ms``, ``device_id``,
    ``signal``, ``category`` and the tagged struct ``value``."""
    good = classified.filter(F.col("reason").isNull())
    keys = [c for c in ENTRY_COLUMNS if c not in VALUE_COLUMNS]
    entries = good.select(*keys, F.inline(F.array("value"))).select(*ENTRY_COLUMNS)
    errors = classified.filter(F.col("reason").isNotNull()).select(
        "source_id", F.col("id").alias("line_key"), F.col("line").alias("content"), "reason"
    )
    return ParsedLog(entries, errors)

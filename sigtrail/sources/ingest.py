"""Reading files of any known format into one pair of frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.operators.resolve import resolve_signal_types
from sigtrail.session import cut_lineage, is_small, scratch_path
from sigtrail.sources.backtick import parse_observable, parse_trs
from sigtrail.sources.detect import detect_format
from sigtrail.sources.generic import parse_generic
from sigtrail.sources.lines import ParsedLog, number_lines, scan_text
from sigtrail.sources.mcs import parse_mcs
from sigtrail.sources.plc import parse_csv_signal, parse_plc_debug, parse_plc_tab
from sigtrail.sources.secs import parse_secs

PARSERS = {
    "plc_debug": (parse_plc_debug, "\n"),
    "plc_tab": (parse_plc_tab, "\n"),
    "mcs_log": (parse_mcs, "\n"),
    "observable_log": (parse_observable, "\n"),
    "csv_signal": (parse_csv_signal, "\n"),
    "secs_log": (parse_secs, "\n@"),
    "generic_log": (parse_generic, "\n"),
    "trs_log": (parse_trs, "\n"),
}
RESOLVING = {"plc_debug": "any", "plc_tab": "last", "csv_signal": "last"}
"""Formats whose signals get one type per file, and the rule for it."""
_LINES = "id long, source_id string, line string, format string"


class IngestedLog(ParsedLog):
    """A parsed log that also knows the name of the format it came from."""

    parser_name: str


def read_logs(spark: SparkSession, paths, fmt: str = "auto", resolve: bool = True) -> IngestedLog:
    """Parse files of one or several formats.

    ``resolve`` settles the types of signals over all rows of a file; where a format needs
    that, its parsed rows are written once and read back.

    With ``auto`` every file is detected on its own; ``parser_name`` is the format, or
    ``merged`` when they mix.  Files of one format are read directly.  Of mixed ones the
    text is scanned once: each line meets its file's format and is written to that
    format's part of a stage, from which the parsers read.  Formats stay in a table with
    a row per file.  SECS records end elsewhere than lines, so if such files are among
    others, a second scan takes theirs.
    """
    if fmt != "auto":
        present = [fmt]
    else:
        formats = cut_lineage(detect_format(spark, paths))
        unknown = F.col("format").isNull()
        found = formats.agg(F.array_sort(F.collect_set("format")), F.min(F.when(unknown, F.col("source_id")))).first()
        if found[1] is not None:
            raise ValueError(f"no suitable format found for {found[1]}")
        present = found[0]
        if not present:
            raise ValueError(f"no log lines in {paths}")
    if len(present) == 1:
        separator = PARSERS[present[0]][1]
        lines = {present[0]: number_lines(scan_text(spark, paths, separator))}
    else:
        lines = _routed(spark, paths, formats, present)
    parts = [_parsed(name, lines[name], resolve) for name in present]
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    log = IngestedLog(union([p.entries for p in parts]), union([p.errors for p in parts]))
    log.parser_name = present[0] if len(present) == 1 else "merged"
    return log


def _parsed(name: str, lines: DataFrame, resolve: bool) -> ParsedLog:
    parsed = PARSERS[name][0](lines)
    if not resolve or name not in RESOLVING:
        return parsed
    return ParsedLog(resolve_signal_types(cut_lineage(parsed.entries), RESOLVING[name]), parsed.errors)


def _routed(spark: SparkSession, paths, formats: DataFrame, present: list[str]) -> dict[str, DataFrame]:
    """Numbered lines of each format, from one scan of all files."""

    def of_format(separator: str) -> DataFrame:
        own = formats.filter(F.col("format").isin([n for n in present if PARSERS[n][1] == separator]))
        lines = number_lines(scan_text(spark, paths, separator))
        return lines.join(F.broadcast(own) if is_small(own) else own, "source_id")

    path = scratch_path(spark, "routed")
    of_format("\n").select("id", "source_id", "line", "format").write.partitionBy("format").parquet(path)
    stage = spark.read.schema(_LINES).parquet(path)
    other = {PARSERS[name][1] for name in present} - {"\n"}
    return {
        name: (of_format(PARSERS[name][1]) if PARSERS[name][1] in other else stage.filter(F.col("format") == name)).drop("format")
        for name in present
    }


def session_summary(
    entries: DataFrame, errors: DataFrame | None = None, parser_name: str | None = None
) -> DataFrame:
    """Per source: entry, signal, device and error counts and the time span."""
    # Distinct signals first, so that a source with many rows is pre-aggregated.
    per_signal = entries.groupBy("source_id", "device_id", "signal").agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts_ms").alias("_lo"), F.max("ts_ms").alias("_hi")
    )
    per_device = per_signal.groupBy("source_id", "device_id").agg(
        F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_signals"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
    )
    summary = per_device.groupBy("source_id").agg(
        F.sum("_n").alias("entry_count"),
        F.sum("_signals").alias("signal_count"),
        F.count(F.lit(1)).alias("device_count"),
        F.min("_lo").alias("start_ms"),
        F.max("_hi").alias("end_ms"),
    )
    if errors is not None:
        counted = errors.groupBy("source_id").agg(F.count(F.lit(1)).alias("error_count"))
        summary = summary.join(counted, "source_id", "full_outer")
    else:
        summary = summary.withColumn("error_count", F.lit(0).cast("long"))
    counts = ["entry_count", "signal_count", "device_count", "error_count"]
    return summary.fillna(0, subset=counts).withColumn("parser_name", F.lit(parser_name))

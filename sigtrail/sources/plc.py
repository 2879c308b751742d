"""PLC debug lines, PLC tab lines and signal CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.functions.text import capture, is_blank, item, strip_bom, trim_space
from sigtrail.functions.typing import extract_device_id, infer_type, parse_ts_ms, with_value
from sigtrail.operators.resolve import resolve_signal_types
from sigtrail.plans.stages import bind
from sigtrail.session import cut_lineage
from sigtrail.sources.lines import ParsedLog, extract, read_lines, split_result

# Line layouts.
PLC_DEBUG_LINE = (
    r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+\[([^\]]+)\]\s+\[([^\]]*)\]"
    r"\s+\[([^:\]]+):([^\]]+)\]\s+\(([^)]+)\)\s*:\s*(.*)\s*$"
)
PLC_TAB_LINE = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s\[\]\s([^\t]+)\t([^\t]+)\t([^\t]*)\t([^\t]*)"
    r"\t([^\t]*)\t([^\t]*)\t([^\t]*)(?:\t([^\t]*))?\t(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s*$"
)
CSV_SIGNAL_LINE = r"(?d)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s*,\s*([^,]+)\s*,\s*([^,]+)\s*,\s*(.*?)\s*$"

# The brackets, the type in parentheses and the value after its colon; white
# space around them is free.
_DEBUG_PARTS = (
    r"(?s)\A([^\[\]\x01]*)\[[^\]\x01]*\][^\[\x01]*\[([^\]\x01]*)\][^\[\x01]*"
    r"\[([^:\]\x01]*):([^\]\x01]*)\][^(\x01]*\(([^)\x01]*)\)[^:\x01]*:(.*)\z"
)
_SHORTEST_FREE_FORM = 40
_DECLARED_TYPES = ["boolean", "integer", "string"]


def parse_plc_debug(lines: DataFrame) -> ParsedLog:
    text = lines.withColumn("line", strip_bom(F.col("line"))).filter(~is_blank(F.col("line")))
    strict = F.rlike("line", F.lit(PLC_DEBUG_LINE))
    parts = text.withColumn("_p", capture(F.col("line"), _DEBUG_PARTS, 6))
    part = lambda i: trim_space(item(F.col("_p"), i))
    fields = extract(
        parts,
        _time=part(0),
        _device=extract_device_id(item(F.col("_p"), 1)),
        category=part(2),
        signal=part(3),
        _dtype=F.lower(part(4)),
        _raw=part(5),
        _free=F.col("_p").isNotNull(),
    )
    fields = bind(
        fields,
        ts_ms=parse_ts_ms(F.col("_time")),
        device_id=F.coalesce(F.nullif("_device", F.lit("")), F.nullif("category", F.lit(""))),
    )
    declared = F.when(F.col("_dtype").isin(_DECLARED_TYPES), F.col("_dtype"))
    complete = F.col("_free") & F.col("ts_ms").isNotNull() & F.col("device_id").isNotNull()
    roomy = F.octet_length("line") >= _SHORTEST_FREE_FORM
    reason = (
        F.when(complete & roomy, F.lit(None))
        .when(~strict, F.lit("line does not match PLC debug format"))
        .when(F.col("ts_ms").isNull(), F.lit("invalid timestamp"))
        .when(F.col("device_id").isNull(), F.lit("device ID not found in path"))
    )
    typed = with_value(fields, "_raw", F.coalesce(declared, infer_type(F.col("_raw"))))
    return split_result(typed.withColumn("reason", reason))


def parse_plc_tab(lines: DataFrame) -> ParsedLog:
    marker = " [] "
    text = lines.filter(~is_blank(F.col("line")))
    # Other white space around the brackets is only accepted in full-length lines.
    spaced = F.when(F.contains("line", F.lit(marker)), F.col("line")).otherwise(
        F.regexp_replace("line", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s\[\]\s", "$1" + marker)
    )
    cut = text.withColumn("_spaced", spaced)
    rest = F.expr(f"substring(_spaced, instr(_spaced, '{marker}') + {len(marker)})")
    parts = cut.withColumn(
        "_p", F.when(F.contains("_spaced", F.lit(marker)), F.split(rest, "\t"))
    )
    part = lambda i: trim_space(item(F.col("_p"), i))
    fields = extract(
        parts,
        _time=F.when(F.col("_p").isNotNull(), trim_space(F.substring_index("_spaced", marker, 1))),
        device_id=extract_device_id(part(0)),
        signal=part(1),
        category=F.lit(""),
        _raw=part(3),
        _shaped=F.coalesce(F.size("_p") >= 4, F.lit(False)),
    )
    fields = bind(fields, ts_ms=parse_ts_ms(F.col("_time")))
    complete = F.col("_shaped") & F.col("ts_ms").isNotNull() & (F.col("device_id") != "")
    reason = (
        F.when(complete, F.lit(None))
        .when(~F.rlike("line", F.lit(PLC_TAB_LINE)), F.lit("line does not match PLC tab format"))
        .when(F.col("ts_ms").isNull(), F.lit("invalid timestamp"))
        .otherwise(F.lit("device ID not found in path"))
    )
    return split_result(with_value(fields, "_raw").withColumn("reason", reason))


def parse_csv_signal(lines: DataFrame) -> ParsedLog:
    text = lines.filter(~is_blank(F.col("line")))
    parts = text.withColumn("_p", F.split("line", ",", 4))
    raw = lambda i: item(F.col("_p"), i)
    part = lambda i: trim_space(raw(i))
    # Full-form lines keep blanks before a comma; free-form ones are trimmed.
    full = F.rlike("line", F.lit(CSV_SIGNAL_LINE))
    kept = lambda i: F.when(full, F.regexp_replace(raw(i), r"\A\s+", "")).otherwise(part(i))
    fields = extract(
        parts,
        _time=part(0),
        _path=kept(1),
        signal=kept(2),
        category=F.lit(""),
        _raw=part(3),
        _shaped=(F.size("_p") >= 4),
    )
    fields = bind(
        fields, ts_ms=parse_ts_ms(F.col("_time")), _device=extract_device_id(F.col("_path"))
    )
    device = F.coalesce(F.nullif("_device", F.lit("")), F.col("_path"))
    reason = F.when(~F.col("_shaped"), F.lit("line does not match CSV signal format")).when(
        F.col("ts_ms").isNull(), F.lit("invalid timestamp")
    )
    typed = with_value(fields, "_raw")
    return split_result(typed.withColumns({"device_id": device, "reason": reason}))


def _resolved(parsed: ParsedLog, rule: str, resolve: bool) -> ParsedLog:
    if not resolve:
        return parsed
    # Types and rows both read the parsed rows, so the text is parsed once for them.
    return ParsedLog(resolve_signal_types(cut_lineage(parsed.entries), rule), parsed.errors)


def read_plc_debug(spark: SparkSession, paths, resolve: bool = True) -> ParsedLog:
    return _resolved(parse_plc_debug(read_lines(spark, paths)), "any", resolve)


def read_plc_tab(spark: SparkSession, paths, resolve: bool = True) -> ParsedLog:
    return _resolved(parse_plc_tab(read_lines(spark, paths)), "last", resolve)


def read_csv_signal(spark: SparkSession, paths, resolve: bool = True) -> ParsedLog:
    return _resolved(parse_csv_signal(read_lines(spark, paths)), "last", resolve)

"""Back-tick delimited logs: observables and transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.functions.text import is_blank, item, strip_bom, trim_space
from sigtrail.functions.transfer import first_filled, pack_transfer, resolve_transfer_location
from sigtrail.functions.typing import infer_type, parse_ts_ms, tagged, with_value
from sigtrail.plans.stages import bind
from sigtrail.sources.lines import ParsedLog, extract, read_lines, split_result

# Header words and declared data types.
OBSERVABLE_HEADER = r"^date\s+time\s+status\s+variables\s+device-id\s+datatype\s+tag(?:\s|$)"
OBSERVABLE_TIME = r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}:\d{3,9}$"
BOOLEAN_TYPES = ["boolean", "bool"]
INTEGER_TYPES = ["short", "integer", "int", "long", "dint", "uint", "ushort", "word", "dword"]
STRING_TYPES = ["string", "text", "char"]
TRANSFER_MIN_FIELDS = 15


def clean_observable(line: Column) -> Column:
    """Drop NUL bytes, a byte-order mark and outer white space."""
    return trim_space(strip_bom(F.replace(line, F.lit("\x00"), F.lit(""))))


def is_observable_header(line: Column) -> Column:
    return F.rlike(F.lower(line), F.lit(OBSERVABLE_HEADER))


def is_observable_line(line: Column) -> Column:
    parts = F.split(line, "`")
    part = lambda i: trim_space(item(parts, i))
    return (
        (F.size(parts) == 9)
        & F.rlike(part(0), F.lit(OBSERVABLE_TIME))
        & (part(1) == "OBSERVABLE")
        & (part(2) != "")
        & (part(3) != "")
        & (part(4) != "")
        & (part(8) != "")
    )


def _after_last(text: Column, marker: str) -> Column:
    return F.when(
        F.contains(text, F.lit(marker)),
        F.nullif(trim_space(F.substring_index(text, marker, -1)), F.lit("")),
    )


def observable_signal(variable: Column) -> Column:
    """Text after the last ``>>>``, else after the last ``<<<``, else the last word."""
    text = trim_space(variable)
    return F.coalesce(
        _after_last(text, ">>>"), _after_last(text, "<<<"), F.regexp_extract(text, r"(\S+)\z", 1)
    )


def observable_type(declared: Column, raw: Column) -> Column:
    name = F.lower(declared)
    return (
        F.when(raw == "", F.lit("string"))
        .when(name.isin(BOOLEAN_TYPES), F.lit("boolean"))
        .when(name.isin(INTEGER_TYPES), F.lit("integer"))
        .when(name.isin(STRING_TYPES), F.lit("string"))
        .otherwise(infer_type(raw))
    )


def _colon_fraction(ts: Column) -> Column:
    """``HH:mm:ss:fff`` -> ``HH:mm:ss.fff``."""
    return F.regexp_replace(ts, r"\A(.{19,}):([^:]*)\z", "$1.$2")


def parse_observable(lines: DataFrame) -> ParsedLog:
    text = lines.withColumn("line", clean_observable(F.col("line"))).filter(
        (F.col("line") != "") & ~is_observable_header(F.col("line"))
    )
    parts = text.withColumn("_p", F.split("line", "`"))
    part = lambda i: trim_space(item(F.col("_p"), i))
    fields = extract(
        parts,
        _shaped=(F.size("_p") == 9),
        _time=_colon_fraction(part(0)),
        _status=part(1),
        _variable=part(2),
        device_id=part(3),
        category=F.lit(""),
        _dtype=part(4),
        _raw=F.coalesce(F.nullif(part(6), F.lit("")), part(5), F.lit("")),
    )
    fields = bind(
        fields, ts_ms=parse_ts_ms(F.col("_time")), signal=observable_signal(F.col("_variable"))
    )
    reason = (
        F.when(~F.col("_shaped"), F.lit("line does not match observable format"))
        .when(F.col("ts_ms").isNull(), F.lit("invalid timestamp"))
        .when(F.col("_status") != "OBSERVABLE", F.lit("invalid observable status"))
        .when(F.col("_variable") == "", F.lit("missing variable field"))
        .when(F.col("device_id") == "", F.lit("missing device-id"))
        .when(F.col("signal") == "", F.lit("missing signal name"))
    )
    typed = with_value(fields, "_raw", observable_type(F.col("_dtype"), F.col("_raw")))
    return split_result(typed.withColumn("reason", reason))


def parse_trs(lines: DataFrame) -> ParsedLog:
    parts = lines.filter(~is_blank(F.col("line"))).withColumn("_p", F.split("line", "`"))
    part = lambda i: trim_space(item(F.col("_p"), i))
    used = [0, 3, 4, 6, 8, 9, 10, 11, 12, 13, 14]
    shaped = extract(
        parts.filter(F.size("_p") >= TRANSFER_MIN_FIELDS), **{f"_f{i}": part(i) for i in used}
    )
    field = lambda i: F.col(f"_f{i}")
    racks = [field(11), field(12)]
    packed = pack_transfer(
        [
            field(3),
            field(4),
            resolve_transfer_location(field(8), racks),
            resolve_transfer_location(field(9), racks),
            first_filled([field(13), field(10)]),
            field(14),
        ]
    )
    timed = bind(shaped, _time=F.regexp_replace(field(0), r"\A(.{19}):(?=.)", "$1."), _packed=packed)
    timed = bind(timed, ts_ms=parse_ts_ms(F.col("_time")))
    return split_result(
        timed.select(
            "id",
            "source_id",
            "line",
            "ts_ms",
            field(6).alias("device_id"),
            F.lit("Transfer").alias("signal"),
            F.lit("").alias("category"),
            tagged(string=F.col("_packed")).alias("value"),
            F.when(F.col("ts_ms").isNull(), F.lit("invalid timestamp")).alias("reason"),
        )
    )


def read_observable(spark: SparkSession, paths) -> ParsedLog:
    return parse_observable(read_lines(spark, paths))


def read_trs(spark: SparkSession, paths) -> ParsedLog:
    return parse_trs(read_lines(spark, paths))

"""Stocker exports that arrive as tables (any ``spark.read`` source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.functions.text import trim_space
from sigtrail.functions.transfer import first_filled, pack_transfer, resolve_transfer_location
from sigtrail.functions.typing import infer_type, parse_ts_ms, tagged, with_value
from sigtrail.operators.resolve import resolve_signal_types
from sigtrail.plans.stages import bind
from sigtrail.sources.lines import ParsedLog, split_result

# Declared value types and the 0-based columns of a transfer row.
INTEGER_TYPES = ["integer", "int", "long", "short", "byte"]
TRANSFER_COLUMNS = {
    "time": 1, "command": 3, "state": 4, "carrier": 6, "source": 8, "dest": 9,
    "crane": 10, "plc_from": 11, "plc_to": 12, "location": 13, "result": 14,
}


def _clean_value(raw: Column) -> Column:
    return F.when(F.startswith(raw, F.lit(":")), trim_space(F.substring(raw, 2, 1 << 30))).otherwise(raw)


def _value_type(declared: Column, raw: Column) -> Column:
    name = F.lower(trim_space(F.coalesce(declared, F.lit(""))))
    mapped = F.when(name == "boolean", F.lit("boolean")).when(
        name.isin(INTEGER_TYPES), F.lit("integer")
    )
    return F.coalesce(mapped, infer_type(raw))


def _keyed(df: DataFrame, id_col: str, source: str | None) -> DataFrame:
    return df.withColumns(
        {"id": F.col(id_col).cast("long"), "source_id": F.lit(source or "stocker")}
    )


def normalize_stk_plc(
    df: DataFrame, id_col: str, source: str | None = None, resolve: bool = True
) -> ParsedLog:
    """``DateTime, SubSystemID, ObservableID, CurrentValue, ValueType`` rows -> entries."""
    shaped = (
        _keyed(df, id_col, source)
        .select(
            "id",
            "source_id",
            F.concat_ws("|", "DateTime", "SubSystemID", "ObservableID", "CurrentValue", "ValueType").alias("line"),
            trim_space(F.col("DateTime")).alias("_time"),
            trim_space(F.col("SubSystemID")).alias("device_id"),
            trim_space(F.col("ObservableID")).alias("signal"),
            F.lit("").alias("category"),
            trim_space(F.coalesce("CurrentValue", F.lit(""))).alias("_cell"),
            F.col("ValueType"),
        )
        .withColumns({"_raw": _clean_value(F.col("_cell")), "ts_ms": parse_ts_ms(F.col("_time"))})
    )
    typed = with_value(shaped, "_raw", _value_type(F.col("ValueType"), F.col("_raw")))
    reason = F.when(F.col("ts_ms").isNull(), F.lit("invalid timestamp"))
    parsed = split_result(typed.withColumn("reason", reason))
    if resolve:
        return ParsedLog(resolve_signal_types(parsed.entries, "any"), parsed.errors)
    return parsed


def normalize_stk_transfer(
    df: DataFrame, id_col: str, columns: list[str], source: str | None = None
) -> ParsedLog:
    """Fifteen columns in export order (``columns``) -> packed ``Transfer`` rows."""
    raw = _keyed(df, id_col, source).select(
        "id",
        "source_id",
        F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("line"),
        *[F.col(columns[i]).alias(f"_raw_{n}") for n, i in TRANSFER_COLUMNS.items()],
    )
    shaped = bind(raw, **{f"_{n}": trim_space(F.coalesce(F.col(f"_raw_{n}"), F.lit(""))) for n in TRANSFER_COLUMNS})
    part = lambda n: F.col(f"_{n}")
    racks = [part("plc_from"), part("plc_to")]
    packed = pack_transfer(
        [
            part("command"),
            part("state"),
            resolve_transfer_location(part("source"), racks),
            resolve_transfer_location(part("dest"), racks),
            first_filled([part("location"), part("crane")]),
            part("result"),
        ]
    )
    timed = bind(shaped, ts_ms=parse_ts_ms(part("time")))
    return split_result(
        timed.select(
            "id",
            "source_id",
            "line",
            "ts_ms",
            part("carrier").alias("device_id"),
            F.lit("Transfer").alias("signal"),
            F.lit("").alias("category"),
            tagged(string=packed).alias("value"),
            F.when(F.col("ts_ms").isNull(), F.lit("invalid timestamp")).alias("reason"),
        )
    )

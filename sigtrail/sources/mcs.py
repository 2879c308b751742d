"""Key/value command logs: one line carries several signals of a carrier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.functions.text import capture, is_blank, item, trim_space
from sigtrail.functions.typing import infer_type, parse_ts_ms, tagged, with_value
from sigtrail.plans.stages import bind
from sigtrail.sources.lines import ParsedLog, extract, read_lines, split_result

# Line layout, pair layout and the keys with a set type.
MCS_LINE = (
    r"(?d)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)\s+\[(ADD|UPDATE|REMOVE)=([^,\]]+)"
    r"(?:,\s*([^\]]+))?\]\s*(.*)?$"
)
_PAIR = r"\[[^=\]]+=[^\]]*\]"
BOOLEAN_KEYS = ["IsBoost", "IsMultiJob", "IsMultipleDestination", "IsLocationGroupOrder", "IsExecuteCommand"]
INTEGER_KEYS = ["Priority", "AltCount", "AltCount2", "WaitCount", "CirculationCount"]
STATE_KEYS = [
    "TransferState", "TransferState2", "TransferAbnormalState", "TransferAbnormalState2",
    "ResultCode", "ResultCode2", "CommandType",
]
LOCATION_KEYS = ["CarrierLoc", "CarrierLocation"]
_RAISED = ["TRUE", "1", "YES", "ON"]


def mcs_key_type(key: Column, value: Column) -> Column:
    return (
        F.when(key.isin(BOOLEAN_KEYS), F.lit("boolean"))
        .when(key.isin(INTEGER_KEYS), F.lit("integer"))
        .when(key.isin(STATE_KEYS), F.lit("string"))
        .otherwise(infer_type(value))
    )


def _cell(name: str, text: Column) -> Column:
    """A signal still to be read: ``name`` is '' for a ``[Key=Value]`` text."""
    return F.struct(F.lit(name).alias("name"), text.alias("text"))


def parse_mcs(lines: DataFrame) -> ParsedLog:
    text = lines.filter(~is_blank(F.col("line")))
    head = extract(
        text.withColumn("_p", capture(F.col("line"), MCS_LINE, 5)),
        _shaped=F.col("_p").isNotNull(),
        _time=item(F.col("_p"), 0),
        _action=item(F.col("_p"), 1),
        _first=trim_space(item(F.col("_p"), 2)),
        _second=trim_space(item(F.col("_p"), 3)),
        _pairs=item(F.col("_p"), 4),
    )
    head = bind(head, ts_ms=parse_ts_ms(F.col("_time")))
    has_command = F.col("_second") != ""
    reason = F.when(~F.col("_shaped"), F.lit("line does not match MCS format")).when(
        F.col("ts_ms").isNull(), F.lit("invalid timestamp")
    )
    classified = head.withColumn("reason", reason)
    found = F.regexp_extract_all("_pairs", F.lit(_PAIR), F.lit(0))
    cells = F.concat(
        F.array(_cell("_Action", F.col("_action")), _cell("_CommandID", F.when(has_command, F.col("_first")))),
        F.transform(found, lambda text: _cell("", text)),
    )
    rows = classified.filter(F.col("reason").isNull()).select(
        "id",
        "source_id",
        "ts_ms",
        F.when(has_command, F.col("_second")).otherwise(F.col("_first")).alias("device_id"),
        F.posexplode(cells).alias("_n", "_c"),
    )
    inner = F.substring("_c.text", F.lit(2), F.length("_c.text") - 2)
    is_pair = F.col("_c.name") == ""
    split = rows.select(
        (F.col("id") + F.col("_n")).alias("id"),
        "source_id",
        "ts_ms",
        "device_id",
        is_pair.alias("_pair"),
        F.when(is_pair, trim_space(F.substring_index(inner, "=", 1))).otherwise(F.col("_c.name")).alias("_key"),
        F.when(is_pair, trim_space(F.regexp_replace(inner, r"\A[^=]*=", "")))
        .otherwise(F.col("_c.text"))
        .alias("_raw"),
    )
    kept = split.filter(
        F.col("_raw").isNotNull()
        & (~F.col("_pair") | ((F.col("_key") != "") & ~F.col("_raw").isin("", "None")))
    )
    named = kept.withColumn(
        "signal",
        F.when(F.col("_key").isin(LOCATION_KEYS), F.lit("CurrentLocation")).otherwise(F.col("_key")),
    )
    kind = F.when(F.col("_pair"), mcs_key_type(F.col("signal"), F.col("_raw"))).otherwise(F.lit("string"))
    typed = with_value(named.withColumn("_kind", kind), "_raw", F.col("_kind"))
    # A boolean key reads every other word as false.
    flag = tagged(boolean=F.upper("_raw").isin(_RAISED))
    value = F.when(F.col("_kind") == "boolean", flag).otherwise(F.col("value"))
    none = F.lit(None).cast("string")
    entries = split_result(
        typed.withColumns({"value": value, "category": F.lit(""), "reason": none, "line": none})
    ).entries
    errors = classified.filter(F.col("reason").isNotNull()).select(
        "source_id", F.col("id").alias("line_key"), F.col("line").alias("content"), "reason"
    )
    return ParsedLog(entries, errors)


def read_mcs(spark: SparkSession, paths) -> ParsedLog:
    return parse_mcs(read_lines(spark, paths))

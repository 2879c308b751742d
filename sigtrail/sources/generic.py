"""Plain time-stamped logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.functions.text import capture, is_blank, item
from sigtrail.functions.typing import parse_ts_ms, tagged
from sigtrail.plans.stages import bind
from sigtrail.sources.lines import ParsedLog, extract, read_lines, split_result

# Fixed value: line layout.
GENERIC_LINE = r"(?d)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(?:\[([^\]]+)\]\s+)?(.*)$"


def parse_generic(lines: DataFrame) -> ParsedLog:
    """Lines of another shape are skipped; a bad timestamp is an error."""
    parts = lines.filter(~is_blank(F.col("line"))).withColumn(
        "_p", capture(F.col("line"), GENERIC_LINE, 3)
    )
    part = lambda i: item(F.col("_p"), i)
    fields = extract(
        parts.filter(F.col("_p").isNotNull()),
        _time=part(0),
        device_id=F.lit("system"),
        signal=F.coalesce(F.nullif(part(1), F.lit("")), F.lit("INFO")),
        category=F.lit(""),
        _message=part(2),
    )
    fields = bind(fields, ts_ms=parse_ts_ms(F.col("_time")))
    return split_result(
        fields.withColumns(
            {
                "value": tagged(string=F.col("_message")),
                "reason": F.when(F.col("ts_ms").isNull(), F.lit("invalid timestamp")),
            }
        )
    )


def read_generic(spark: SparkSession, paths) -> ParsedLog:
    return parse_generic(read_lines(spark, paths))

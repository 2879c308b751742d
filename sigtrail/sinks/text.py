"""Writing results as delimited text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.functions.values import value_text
from sigtrail.schema import TIME_ORDER

# Column titles of exported transitions.
TRANSITION_TITLES = ["Start Time (ISO)", "End Time (ISO)", "Duration (ms)", "Status"]


def iso_time(ms: Column, between: str = "T", zone: str = "Z") -> Column:
    """Epoch milliseconds as ``yyyy-MM-ddTHH:mm:ss.SSSZ``, always UTC."""
    in_day = F.pmod(ms, F.lit(86_400_000))
    day = F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int"))
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    return F.concat(
        F.date_format(day, "yyyy-MM-dd"),
        F.lit(between),
        two(in_day / 3_600_000),
        F.lit(":"),
        two(in_day % 3_600_000 / 60_000),
        F.lit(":"),
        two(in_day % 60_000 / 1000),
        F.lit("."),
        F.lpad((in_day % 1000).cast("string"), 3, "0"),
        F.lit(zone),
    )


def clean_cell(text: Column) -> Column:
    """Tabs and line breaks as blanks."""
    return F.regexp_replace(text, r"\r\n|[\t\n]", " ")


def transition_table(found: DataFrame) -> DataFrame:
    values = [
        iso_time(F.col("start_ms")), iso_time(F.col("end_ms")),
        F.col("duration_ms").cast("string"), F.col("status"),
    ]
    return found.select(*[v.alias(t) for v, t in zip(values, TRANSITION_TITLES)])


def write_transitions(found: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with quoting where needed, or TSV with tabs and line breaks cleaned."""
    table = transition_table(found.sort("start_ms", "end_ms"))
    writer = table.write.mode("overwrite").option("header", True)
    if fmt == "csv":
        writer.option("escape", '"').csv(path)
    elif fmt == "tsv":
        cleaned = table.select(*[clean_cell(F.col(f"`{t}`")).alias(t) for t in TRANSITION_TITLES])
        cleaned.write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def entry_table(entries: DataFrame) -> DataFrame:
    return entries.select(
        iso_time(F.col("ts_ms"), " ", "").alias("time"),
        "device_id",
        "signal",
        value_text().alias("value"),
    )


def write_entries_tsv(entries: DataFrame, path: str) -> None:
    table = entry_table(entries.sort(*TIME_ORDER))
    table = table.select(*[clean_cell(F.col(c)).alias(c) for c in table.columns])
    table.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def write_entries_json(entries: DataFrame, path: str) -> None:
    """One JSON object per row; absent value columns are left out."""
    entries.sort(*TIME_ORDER).write.mode("overwrite").json(path)

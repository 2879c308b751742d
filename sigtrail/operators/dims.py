"""Distinct lists of categories, signals, devices and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrail.functions.values import signal_type
from sigtrail.schema import SIGNAL_KEY

MISSING_CATEGORY = "(Uncategorized)"


def categories(entries: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Categories in order; with ``keep_missing`` absent ones show under a fixed label."""
    if keep_missing:
        named = F.coalesce(F.nullif("category", F.lit("")), F.lit(MISSING_CATEGORY))
        found = entries.select(named.alias("category"))
    else:
        found = entries.select("category").filter(F.col("category") != "")
    return found.distinct().orderBy("category")


def signals(entries: DataFrame) -> DataFrame:
    return entries.select(*SIGNAL_KEY).distinct().orderBy(*SIGNAL_KEY)


def devices(entries: DataFrame) -> DataFrame:
    return entries.select("device_id").distinct().orderBy("device_id")


def types(entries: DataFrame) -> DataFrame:
    return entries.select(signal_type().alias("signal_type")).distinct().orderBy("signal_type")


def signals_by_device(entries: DataFrame) -> DataFrame:
    """Signal names per device.  The list holds distinct names, not rows."""
    named = entries.select(*SIGNAL_KEY).filter((F.col("device_id") != "") & (F.col("signal") != ""))
    return (
        named.distinct()
        .groupBy("device_id")
        .agg(F.sort_array(F.collect_list("signal")).alias("signals"))
        .orderBy("device_id")
    )

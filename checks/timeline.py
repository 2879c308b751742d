"""Questions answered from a timeline, with the SQL of the same questions over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.asof import K, every_day
from checks.registry import CHECKS, DAY_MS, END_MS, START_MS, T_MS, check
from checks.units import CAR
from sigtrail.adapters import carriers, color_rules, device_mapping, int_entries, mixed_entries
from sigtrail.operators import asof, units
from sigtrail.session import scratch_path
from sigtrail.sinks.timeline import append_timeline

SPLIT_MS = T_MS // (4 * DAY_MS) * (4 * DAY_MS)


def timeline(rows):
    """Written as two appends, with intervals of four days."""
    path = scratch_path(rows.sparkSession, "timeline")
    append_timeline(rows.filter(F.col("ts_ms") < SPLIT_MS), path, 4 * DAY_MS)
    return append_timeline(rows.filter(F.col("ts_ms") >= SPLIT_MS), path)


@check(CHECKS["values_at"].sql)
def timeline_values_at(spark, sf):
    line = timeline(int_entries(spark, sf))
    return asof.values_at(line.upto(T_MS), T_MS).selectExpr("id", "ts_ms", "device_id", "signal", K)


@check(CHECKS["values_at_times"].sql)
def timeline_values_at_times(spark, sf):
    rows, days = int_entries(spark, sf), every_day(spark, sf)
    first, last = days.agg(F.min("t_ms"), F.max("t_ms")).first()
    found = asof.values_at_times(timeline(rows).around(first, last), days)
    return found.selectExpr("t_ms", "id", "ts_ms", "device_id", "signal", K)


@check(CHECKS["boundary_values"].sql)
def timeline_boundary_values(spark, sf):
    near = timeline(int_entries(spark, sf)).around(START_MS, END_MS)
    wanted = near.filter(F.col("signal").isin("view", "click")).select("device_id", "signal").distinct()
    rows = asof.boundary_values(near, START_MS, END_MS, wanted)
    return rows.selectExpr("side", "id", "ts_ms", "device_id", "signal", K)


@check(CHECKS["chunk_with_lead_in"].sql)
def timeline_chunk_with_lead_in(spark, sf):
    near = timeline(int_entries(spark, sf)).around(T_MS, END_MS)
    return asof.chunk_with_lead_in(near, T_MS, END_MS).selectExpr("id", "ts_ms", "device_id", "signal", K, "lead_in")


@check(f"WITH {CAR} SELECT * FROM here")
def timeline_carrier_locations(spark, sf):
    return units.carrier_locations(timeline(carriers(spark, sf)).upto(T_MS), T_MS)


@check(CHECKS["unit_status"].sql)
def timeline_unit_status(spark, sf):
    """Units come from the snapshot before the end of time, which has every device."""
    line = timeline(mixed_entries(spark, sf))
    mapped = units.map_devices(line.upto(1 << 60), device_mapping(spark))
    return units.unit_status(line.upto(T_MS), T_MS, color_rules(spark), device_mapping(spark), units=mapped)

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import EV, check
from sigtrail.adapters import int_entries, state_entries
from sigtrail.operators import merge


def overlapping(spark, sf, make):
    """The log, reported again 200 ms and 1100 ms later by two other sources."""
    rows = make(spark, sf)
    later = lambda ms: rows.withColumn("ts_ms", F.col("ts_ms") + ms)
    return merge.merge_logs([rows, later(200), later(1100)], ["a", "b", "c"])


def _sources(value: str, signal: str) -> str:
    return EV + f""", m AS (SELECT s.source_id, id, ts_ms + s.shift AS ts_ms, device_id, {signal} AS signal, {value} AS v
  FROM ev, (VALUES ('a', 0), ('b', 200), ('c', 1100)) s(source_id, shift))"""


def _kept(value: str, signal: str, scope: str) -> str:
    """Row-by-row inside each stretch of equal rows."""
    over = f"OVER ({scope} ORDER BY ts_ms, source_id, id)"
    return f"""WITH RECURSIVE {_sources(value, signal)},
l AS (SELECT *, CASE WHEN lag(device_id) {over} IS NOT DISTINCT FROM device_id AND lag(signal) {over} IS NOT DISTINCT FROM signal AND lag(v) {over} IS NOT DISTINCT FROM v THEN 0 ELSE 1 END AS head FROM m),
g AS (SELECT *, sum(head) {over} AS grp FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY {scope.replace('PARTITION BY', '') + ',' if scope else ''} grp ORDER BY ts_ms, source_id, id) AS i FROM g),
steps AS (
  SELECT source_id, id, ts_ms, device_id, signal, v, grp, i, ts_ms AS last, true AS keep FROM n WHERE i = 1
  UNION ALL
  SELECT n.source_id, n.id, n.ts_ms, n.device_id, n.signal, n.v, n.grp, n.i,
    CASE WHEN n.ts_ms - p.last < 1000 THEN p.last ELSE n.ts_ms END, n.ts_ms - p.last >= 1000
  FROM steps p JOIN n ON n.grp = p.grp AND n.i = p.i + 1 {'AND n.device_id = p.device_id AND n.signal = p.signal' if scope else ''})
SELECT source_id, id, ts_ms, device_id, signal, v FROM steps WHERE keep"""


def _columns(rows, value):
    return rows.select("source_id", "id", "ts_ms", "device_id", "signal", F.col(value).alias("v"))


@check(f"WITH {_sources('k', 'signal')} SELECT source_id, id, ts_ms, device_id, signal, v FROM m")
def merge_sources(spark, sf):
    return _columns(overlapping(spark, sf, int_entries), "val_int")


@check(_kept("k", "signal", ""))
def dedupe_adjacent(spark, sf):
    return _columns(merge.dedupe(overlapping(spark, sf, int_entries)), "val_int")


@check(_kept("signal", "'State'", "PARTITION BY device_id, signal"))
def dedupe_per_signal(spark, sf):
    rows = overlapping(spark, sf, state_entries)
    return _columns(merge.dedupe(rows, scope="per_signal"), "val_str")

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import DAY_MS, END_MS, EV, START_MS, T_MS, check
from sigtrail.adapters import bool_entries, events, int_entries, mixed_entries
from sigtrail.operators import asof
from sigtrail.operators.filters import EntryFilter

K = "val_int AS k"
SIGNALS = ["U1::view", "U2::view", "U3::error", "U5::click"]
IN_SIGNALS = "((device_id, signal) IN (('U1', 'view'), ('U2', 'view'), ('U3', 'error'), ('U5', 'click')))"


def every_day(spark, sf):
    """Noon of every day that has events."""
    noon = (F.floor(F.col("ts_ms") / DAY_MS) * DAY_MS + DAY_MS // 2).cast("long")
    return events(spark, sf).select(noon.alias("t_ms")).distinct()


DAYS = f"days AS (SELECT DISTINCT CAST(floor(ts_ms / {DAY_MS}.0) AS BIGINT) * {DAY_MS} + {DAY_MS // 2} AS t_ms FROM ev)"


@check(f"WITH {EV} SELECT id, ts_ms, device_id, signal, k FROM ev WHERE ts_ms BETWEEN {START_MS} AND {END_MS}")
def chunk(spark, sf):
    return asof.chunk(int_entries(spark, sf), START_MS, END_MS).selectExpr("id", "ts_ms", "device_id", "signal", K)


@check(f"WITH {EV} SELECT id, ts_ms, device_id, signal, k FROM ev WHERE ts_ms BETWEEN {START_MS} AND {END_MS} AND {IN_SIGNALS}")
def chunk_of_signals(spark, sf):
    rows = asof.chunk(int_entries(spark, sf), START_MS, END_MS, SIGNALS)
    return rows.selectExpr("id", "ts_ms", "device_id", "signal", K)


@check(f"WITH {EV} SELECT id, ts_ms, device_id, signal, k FROM ev WHERE {IN_SIGNALS}")
def signal_rows(spark, sf):
    return asof.signal_entries(int_entries(spark, sf), SIGNALS).selectExpr("id", "ts_ms", "device_id", "signal", K)


@check(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY device_id, signal ORDER BY ts_ms DESC, id DESC) AS n FROM ev WHERE ts_ms <= {T_MS}) SELECT id, ts_ms, device_id, signal, k FROM r WHERE n = 1")
def values_at(spark, sf):
    return asof.values_at(int_entries(spark, sf), T_MS).selectExpr("id", "ts_ms", "device_id", "signal", K)


@check(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY device_id, signal ORDER BY ts_ms DESC, id DESC) AS n FROM ev WHERE ts_ms <= {T_MS} AND (signal = 'click' OR (device_id = 'U3' AND signal = 'view'))) SELECT id, ts_ms, device_id, signal, k FROM r WHERE n = 1")
def values_at_named(spark, sf):
    rows = asof.values_at(int_entries(spark, sf), T_MS, ["click", "U3::view"])
    return rows.selectExpr("id", "ts_ms", "device_id", "signal", K)


_AT_TIMES = f"""WITH {EV}, {DAYS}, r AS (
  SELECT t_ms, ev.*, row_number() OVER (PARTITION BY t_ms, device_id, signal ORDER BY ts_ms DESC, id DESC) AS n
  FROM days JOIN ev ON ts_ms <= t_ms)
SELECT t_ms, id, ts_ms, device_id, signal, k FROM r WHERE n = 1"""


@check(_AT_TIMES)
def values_at_times(spark, sf):
    rows = asof.values_at_times(int_entries(spark, sf), every_day(spark, sf))
    return rows.selectExpr("t_ms", "id", "ts_ms", "device_id", "signal", K)


@check(_AT_TIMES)
def values_at_times_many(spark, sf):
    """The form for more probe times than a plan carries."""
    rows = asof.values_at_times(int_entries(spark, sf), every_day(spark, sf), max_slots=1)
    return rows.selectExpr("t_ms", "id", "ts_ms", "device_id", "signal", K)


@check(f"""{_AT_TIMES.replace("SELECT t_ms, id, ts_ms, device_id, signal, k FROM r WHERE n = 1", "")}
SELECT min(t_ms) AS from_ms, max(t_ms) AS to_ms, id, ts_ms, device_id, signal, k FROM r WHERE n = 1 GROUP BY id, ts_ms, device_id, signal, k""")
def value_ranges(spark, sf):
    """A row for each held value instead of one for each probe."""
    rows = asof.value_ranges(int_entries(spark, sf), every_day(spark, sf))
    return rows.selectExpr("from_ms", "to_ms", "id", "ts_ms", "device_id", "signal", K)


@check(f"""WITH {EV}, b AS (
  SELECT 'before' AS side, *, row_number() OVER (PARTITION BY device_id, signal ORDER BY ts_ms DESC, id DESC) AS n FROM ev WHERE ts_ms < {START_MS}
  UNION ALL
  SELECT 'after', *, row_number() OVER (PARTITION BY device_id, signal ORDER BY ts_ms, id) FROM ev WHERE ts_ms > {END_MS})
SELECT side, id, ts_ms, device_id, signal, k FROM b WHERE n = 1 AND signal IN ('view', 'click')""")
def boundary_values(spark, sf):
    entries = int_entries(spark, sf)
    wanted = entries.filter(F.col("signal").isin("view", "click")).select("device_id", "signal").distinct()
    rows = asof.boundary_values(entries, START_MS, END_MS, wanted)
    return rows.selectExpr("side", "id", "ts_ms", "device_id", "signal", K)


@check(f"""WITH {EV}, l AS (SELECT *, row_number() OVER (PARTITION BY device_id, signal ORDER BY ts_ms DESC, id DESC) AS n FROM ev WHERE ts_ms < {T_MS})
SELECT id, ts_ms, device_id, signal, k, false AS lead_in FROM ev WHERE ts_ms BETWEEN {T_MS} AND {END_MS}
UNION ALL SELECT id, ts_ms, device_id, signal, k, true FROM l WHERE n = 1""")
def chunk_with_lead_in(spark, sf):
    rows = asof.chunk_with_lead_in(int_entries(spark, sf), T_MS, END_MS)
    return rows.selectExpr("id", "ts_ms", "device_id", "signal", K, "lead_in")


@check(f"""WITH {EV}, l AS (SELECT *, row_number() OVER (PARTITION BY device_id, signal ORDER BY ts_ms DESC, id DESC) AS n FROM ev WHERE ts_ms < {START_MS}),
w AS (SELECT id, ts_ms, device_id, signal, k, ts_ms AS from_ms, false AS lead_in FROM ev WHERE ts_ms BETWEEN {START_MS} AND {END_MS}
      UNION ALL SELECT id, ts_ms, device_id, signal, k, {START_MS}, true FROM l WHERE n = 1),
h AS (SELECT *, coalesce(lead(ts_ms) OVER (PARTITION BY device_id, signal ORDER BY ts_ms, id), {END_MS}) AS to_ms FROM w)
SELECT device_id, signal, k, from_ms, to_ms, to_ms - from_ms AS held_ms FROM h WHERE NOT lead_in OR to_ms > from_ms""")
def state_intervals(spark, sf):
    rows = asof.state_intervals(int_entries(spark, sf), START_MS, END_MS)
    return rows.selectExpr("device_id", "signal", K, "from_ms", "to_ms", "held_ms")


@check(f"""WITH {EV}, p AS (SELECT *, k >= 50 AS high, lag(k >= 50) OVER (PARTITION BY device_id, signal ORDER BY ts_ms, id) AS was
FROM ev WHERE ts_ms BETWEEN {START_MS} AND {END_MS}) SELECT id, device_id, signal, ts_ms, high FROM p WHERE was <> high""")
def boolean_edges(spark, sf):
    rows = asof.boolean_edges(bool_entries(spark, sf), START_MS, END_MS)
    return rows.select("id", "device_id", "signal", "ts_ms", "high")


@check(f"WITH {EV} SELECT DISTINCT device_id, signal FROM ev WHERE ts_ms BETWEEN {T_MS} AND {T_MS + DAY_MS}")
def signals_changed_in(spark, sf):
    return asof.signals_changed_in(int_entries(spark, sf), T_MS, T_MS + DAY_MS)


NEAR_MS = 6 * 3_600_000


@check(f"""WITH {EV}, {DAYS}, p AS (SELECT DISTINCT device_id, signal, t_ms FROM ev, days WHERE signal IN ('view', 'error')),
c AS (SELECT p.*, ev.ts_ms, row_number() OVER (PARTITION BY p.device_id, p.signal, t_ms ORDER BY abs(ts_ms - t_ms), ts_ms) AS n
      FROM p LEFT JOIN ev ON ev.device_id = p.device_id AND ev.signal = p.signal AND abs(ev.ts_ms - t_ms) < {NEAR_MS})
SELECT device_id, signal, t_ms, ts_ms AS nearest_ms FROM c WHERE n = 1""")
def nearest_event(spark, sf):
    entries = int_entries(spark, sf)
    days = every_day(spark, sf).agg(F.collect_list("t_ms")).scalar()
    wanted = entries.filter(F.col("signal").isin("view", "error")).select("device_id", "signal").distinct()
    probes = wanted.withColumn("t_ms", F.explode(days))
    return asof.nearest_event(entries, probes, NEAR_MS)


_MARKS = f"WITH {EV}, {DAYS}, m AS (SELECT DISTINCT ts_ms AS time_ms FROM ev WHERE signal = 'signup' AND k = 42)"


@check(f"{_MARKS} SELECT t_ms, (SELECT min(time_ms) FROM m WHERE time_ms > t_ms) AS marker_ms FROM days")
def next_marker(spark, sf):
    marks = int_entries(spark, sf).filter("signal = 'signup' AND val_int = 42").select(F.col("ts_ms").alias("time_ms"))
    return asof.next_marker(marks, every_day(spark, sf))


@check(f"{_MARKS} SELECT t_ms, (SELECT max(time_ms) FROM m WHERE time_ms < t_ms) AS marker_ms FROM days")
def prev_marker(spark, sf):
    marks = int_entries(spark, sf).filter("signal = 'signup' AND val_int = 42").select(F.col("ts_ms").alias("time_ms"))
    return asof.prev_marker(marks, every_day(spark, sf))


@check(f"""WITH {EV} SELECT strftime(make_timestamp(ts_ms // 1000 * 1000000), '%Y-%m-%d') AS date,
CAST(ts_ms // 3600000 % 24 AS INTEGER) AS hour, CAST(ts_ms // 60000 % 60 AS INTEGER) AS minute,
CAST(ts_ms // 1000 % 60 AS INTEGER) AS second, min(ts_ms) AS ts_ms
FROM (SELECT ts_ms AS t, * FROM ev WHERE signal = 'error') GROUP BY t // 1000, 1, 2, 3, 4""")
def time_tree(spark, sf):
    return asof.time_tree(int_entries(spark, sf), EntryFilter(signal_names=("error",)))


@check(f"WITH {EV} SELECT min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, max(ts_ms) - min(ts_ms) AS duration_ms FROM ev WHERE signal = 'click'")
def time_range(spark, sf):
    return asof.time_range(mixed_entries(spark, sf).filter("signal = 'click'"))

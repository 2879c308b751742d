from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import EV, MIXED, check
from sigtrail.adapters import as_entries, events, int_entries, mixed_entries, table
from sigtrail.functions.typing import extract_device_id, tagged
from sigtrail.operators import dims, resolve


@check(f"WITH {EV} SELECT DISTINCT category FROM ev")
def categories(spark, sf):
    return dims.categories(int_entries(spark, sf))


@check(f"WITH {EV} SELECT DISTINCT CASE WHEN k < 20 THEN '(Uncategorized)' ELSE category END AS category FROM ev")
def categories_with_missing(spark, sf):
    rows = int_entries(spark, sf)
    blanked = rows.withColumn("category", F.when(F.col("val_int") < 20, "").otherwise(F.col("category")))
    return dims.categories(blanked, keep_missing=True)


@check(f"WITH {EV} SELECT DISTINCT device_id, signal FROM ev")
def signals(spark, sf):
    return dims.signals(int_entries(spark, sf))


@check(f"WITH {EV} SELECT DISTINCT device_id FROM ev")
def devices(spark, sf):
    return dims.devices(int_entries(spark, sf))


@check(f"WITH {MIXED} SELECT DISTINCT CASE val_type WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' ELSE 'string' END AS signal_type FROM mixed")
def value_types(spark, sf):
    return dims.types(mixed_entries(spark, sf))


@check(f"WITH {EV} SELECT device_id, array_to_string(list_sort(list(DISTINCT signal)), ',') AS signals FROM ev GROUP BY 1")
def signals_by_device(spark, sf):
    rows = dims.signals_by_device(int_entries(spark, sf))
    return rows.select("device_id", F.array_join("signals", ",").alias("signals"))


def blurred_entries(spark, sf):
    """Signals whose rows disagree on type: booleans, 0/1, other integers and text."""
    k, signal = F.col("k"), F.col("signal")
    value = tagged(
        boolean=F.when((k < 30) & (signal != "signup"), k < 15),
        integer=F.when(k < 95, F.when(signal.isin("click", "signup"), k % 2).otherwise(k % 4)),
        string=F.when(signal == "error", F.lit("jam")).otherwise(F.lit("1e3")),
    )
    # Only some devices report text at all.
    rows = events(spark, sf).withColumn(
        "k", F.when(F.col("device_id").endswith("1") & (F.col("k") >= 95), 70).otherwise(F.col("k"))
    )
    return as_entries(rows, value)


BLURRED = (
    EV
    + """, kk AS (SELECT id, ts_ms, device_id, signal, CASE WHEN device_id LIKE '%1' AND k >= 95 THEN 70 ELSE k END AS k FROM ev),
b AS (SELECT *, CASE WHEN k < 30 AND signal <> 'signup' THEN 0 WHEN k < 95 THEN 1 ELSE 3 END AS val_type,
  CASE WHEN k < 30 AND signal <> 'signup' THEN k < 15 END AS val_bool,
  CASE WHEN NOT (k < 30 AND signal <> 'signup') AND k < 95 THEN CASE WHEN signal IN ('click', 'signup') THEN k % 2 ELSE k % 4 END END AS val_int,
  CASE WHEN k >= 95 THEN CASE WHEN signal = 'error' THEN 'jam' ELSE '1e3' END END AS val_str FROM kk)"""
)

_RESOLVED = """SELECT id, device_id, signal,
  CASE WHEN kind = 'integer' AND val_type = 0 THEN 1 WHEN kind = 'boolean' AND val_type = 1 AND {any} THEN 0 ELSE val_type END AS val_type,
  CASE WHEN kind = 'integer' AND val_type = 0 THEN NULL WHEN kind = 'boolean' AND val_type = 1 AND {any} THEN val_int <> 0 ELSE val_bool END AS val_bool,
  CASE WHEN kind = 'integer' AND val_type = 0 THEN CAST(val_bool AS BIGINT) WHEN kind = 'boolean' AND val_type = 1 AND {any} THEN NULL ELSE val_int END AS val_int,
  val_str FROM b JOIN kinds USING (device_id, signal)"""


def _columns(rows):
    return rows.select(
        "id", "device_id", "signal", F.col("val_type").cast("int").alias("val_type"), "val_bool", "val_int", "val_str"
    )


@check(f"""WITH {BLURRED}, kinds AS (SELECT device_id, signal,
  CASE WHEN bool_or(val_type = 1 AND val_int NOT IN (0, 1)) THEN 'integer' WHEN bool_or(val_type = 3) THEN 'string' ELSE 'boolean' END AS kind
  FROM b GROUP BY ALL) {_RESOLVED.format(any='true')}""")
def resolve_types_any(spark, sf):
    return _columns(resolve.resolve_signal_types(blurred_entries(spark, sf), "any"))


@check(f"""WITH {BLURRED}, kinds AS (SELECT device_id, signal,
  coalesce(arg_max(CASE WHEN val_type = 3 THEN 'string' ELSE 'integer' END, id) FILTER (val_type = 3 OR (val_type = 1 AND val_int NOT IN (0, 1))), 'boolean') AS kind
  FROM b GROUP BY ALL) {_RESOLVED.format(any='false')}""")
def resolve_types_last(spark, sf):
    return _columns(resolve.resolve_signal_types(blurred_entries(spark, sf), "last"))


@check(f"""WITH {BLURRED} SELECT device_id, signal, CASE max(CASE val_type WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END)
  WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' ELSE 'string' END AS signal_type FROM b GROUP BY ALL""")
def signal_types(spark, sf):
    return resolve.signal_types(blurred_entries(spark, sf))


@check("""WITH p AS (SELECT event_id AS id, CASE event_type
    WHEN 'view' THEN 'Area/Zone.' || 'DEV-' || user_id || '@D' || event_id
    WHEN 'click' THEN 'a\\b]DEV_' || user_id
    WHEN 'error' THEN 'Zone/has space ' || user_id
    WHEN 'signup' THEN 'Zone/x@' || user_id || '.9' ELSE '' || user_id || '/' END AS path FROM events),
  s AS (SELECT id, path, regexp_extract(path, '[^/\\\\\\].]*$') AS seg FROM p),
  c AS (SELECT id, path, CASE WHEN contains(seg, '@') THEN substr(seg, 1, instr(seg, '@') - 1) ELSE seg END AS seg FROM s)
SELECT id, path, CASE WHEN regexp_matches(seg, '^[A-Za-z0-9_-]+$') THEN seg ELSE '' END AS device_id FROM c""")
def device_ids(spark, sf):
    number = F.col("user_id").cast("string")
    kind, event = F.col("event_type"), F.col("event_id").cast("string")
    path = (
        F.when(kind == "view", F.concat(F.lit("Area/Zone.DEV-"), number, F.lit("@D"), event))
        .when(kind == "click", F.concat(F.lit("a\\b]DEV_"), number))
        .when(kind == "error", F.concat(F.lit("Zone/has space "), number))
        .when(kind == "signup", F.concat(F.lit("Zone/x@"), number, F.lit(".9")))
        .otherwise(F.concat(number, F.lit("/")))
    )
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), path.alias("path"))
    return rows.withColumn("device_id", extract_device_id(F.col("path")))

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import EV, MIXED, START_MS, T_MS, check
from sigtrail.adapters import int_entries, mixed_entries, state_entries, transfers
from sigtrail.functions.values import signal_type
from sigtrail.operators import asof, filters
from sigtrail.operators.filters import EntryFilter, filter_entries, search

KEYS = ["id", "ts_ms", "device_id", "signal"]


@check(f"WITH {EV} SELECT id, device_id, signal, k FROM ev WHERE device_id ILIKE '%u14%' OR signal ILIKE '%u14%' OR CAST(k AS VARCHAR) ILIKE '%u14%'")
def search_substring(spark, sf):
    return search(int_entries(spark, sf), "u14").select("id", "device_id", "signal", F.col("val_int").alias("k"))


@check(f"WITH {MIXED} SELECT id, device_id, signal FROM mixed WHERE (contains(device_id, 'level 3') OR contains(signal, 'level 3') OR contains(coalesce(val_str, ''), 'level 3'))")
def search_case_sensitive(spark, sf):
    return search(mixed_entries(spark, sf), "level 3", case_sensitive=True).select("id", "device_id", "signal")


@check(f"WITH {EV} SELECT id, device_id, signal, k FROM ev WHERE regexp_matches(device_id, '^U1[0-4]$') OR regexp_matches(signal, '^U1[0-4]$') OR regexp_matches(CAST(k AS VARCHAR), '^U1[0-4]$')")
def search_regex(spark, sf):
    return search(int_entries(spark, sf), "^U1[0-4]$", regex=True).select(
        "id", "device_id", "signal", F.col("val_int").alias("k")
    )


@check(f"WITH {EV} SELECT id, category, signal FROM ev WHERE regexp_matches(device_id, '(?i)^(c|vie)') OR regexp_matches(signal, '(?i)^(c|vie)') OR regexp_matches(CAST(k AS VARCHAR), '(?i)^(c|vie)') OR regexp_matches(category, '(?i)^(c|vie)')")
def search_any_field(spark, sf):
    rows = search(
        int_entries(spark, sf), "^(C|vie)", regex=True, include_category=True, ignore_regex_case=True
    )
    return rows.select("id", "category", "signal")


@check(f"WITH {EV} SELECT id, signal FROM ev WHERE contains(lower(signal), '(view')")
def search_invalid_regex(spark, sf):
    rows = search(int_entries(spark, sf), "(VIEW", regex=True, ignore_regex_case=True)
    return rows.select("id", "signal")


@check(f"WITH {EV} SELECT id, signal FROM ev WHERE regexp_matches(device_id, '^\\p{{Lu}}1+$') OR regexp_matches(signal, '^\\p{{Lu}}1+$')")
def search_letter_class(spark, sf):
    return search(int_entries(spark, sf), r"^\p{Lu}1+$", regex=True, ignore_regex_case=True, case_sensitive=True).select("id", "signal")


@check(f"WITH {EV} SELECT id, signal FROM ev WHERE contains(signal, '(?p<a>v)')")
def search_foreign_regex(spark, sf):
    return search(int_entries(spark, sf), "(?P<a>v)", regex=True, ignore_regex_case=True).select("id", "signal")


@check(f"WITH {EV} SELECT id, category, signal FROM ev WHERE category IN ('C', 'P')")
def filter_category(spark, sf):
    return filter_entries(int_entries(spark, sf), categories=("C", " P ,C")).select("id", "category", "signal")


@check(f"WITH {EV} SELECT id, signal FROM ev WHERE signal IN ('view', 'error')")
def filter_signal_name(spark, sf):
    return filter_entries(int_entries(spark, sf), signal_names=("view,error",)).select("id", "signal")


@check(f"WITH {EV} SELECT id, device_id FROM ev WHERE device_id IN ('U1', 'U2', 'U3')")
def filter_device(spark, sf):
    return filter_entries(int_entries(spark, sf), device_ids=("U1", "U2", "U3", "U2")).select("id", "device_id")


@check(f"WITH {EV} SELECT id, device_id, signal FROM ev WHERE (device_id = 'U1' AND signal = 'view') OR (device_id = 'U2' AND signal IN ('view', 'error'))")
def filter_pairs(spark, sf):
    keys = ("U1::view", "U2::view", "U2::error", "malformed", "a::b::c")
    return filter_entries(int_entries(spark, sf), signals=keys).select("id", "device_id", "signal")


@check(f"WITH {MIXED} SELECT id, signal, val_int FROM mixed WHERE val_type = 1")
def filter_value_type(spark, sf):
    return filter_entries(mixed_entries(spark, sf), signal_type="integer").select("id", "signal", "val_int")


@check(f"WITH {MIXED} SELECT id, device_id, signal, category FROM mixed WHERE category IN ('S', 'E') AND signal IN ('signup', 'error', 'view') AND val_type = 3 AND (device_id ILIKE '%7%' OR signal ILIKE '%7%' OR val_str ILIKE '%7%')")
def filter_combined(spark, sf):
    flt = EntryFilter(text="7", categories=("S", "E"), signal_names=("signup", "error", "view"), signal_type="string")
    return filter_entries(mixed_entries(spark, sf), flt).select("id", "device_id", "signal", "category")


@check(f"WITH {MIXED}, s AS (SELECT DISTINCT device_id, signal, CASE val_type WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' ELSE 'string' END AS signal_type FROM mixed) SELECT * FROM s WHERE regexp_matches(device_id, '(?i)u12') OR regexp_matches(signal, '(?i)u12') OR contains(signal, 'zz')")
def signal_list_by_device(spark, sf):
    listed = mixed_entries(spark, sf).select("device_id", "signal", signal_type().alias("signal_type")).distinct()
    return filters.search_signals(listed, "u12")


@check(f"WITH {MIXED}, s AS (SELECT DISTINCT device_id, signal, CASE val_type WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' ELSE 'string' END AS signal_type FROM mixed), c AS (SELECT DISTINCT device_id, signal FROM mixed WHERE ts_ms BETWEEN {START_MS} AND {T_MS}) SELECT s.* FROM s JOIN c USING (device_id, signal) WHERE signal_type = 'string' AND (regexp_matches(signal, '(?i)^(sign|purch)') OR regexp_matches(device_id, '(?i)^(sign|purch)'))")
def signal_list_changed(spark, sf):
    entries = mixed_entries(spark, sf)
    listed = entries.select("device_id", "signal", signal_type().alias("signal_type")).distinct()
    changed = asof.signals_changed_in(entries, START_MS, T_MS)
    return filters.search_signals(listed, "^(SIGN|PURCH)", regex=True, signal_type="string", changed=changed)


@check("""SELECT 'C' || l_orderkey AS device_id, epoch_ms(l_shipdate) AS ts_ms, count(*) AS n
FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL""")
def transfer_completed(spark, sf):
    rows = filters.completed_transfers(transfers(spark, sf).unionByName(state_entries(spark, sf)))
    return rows.groupBy("device_id", "ts_ms").agg(F.count(F.lit(1)).alias("n"))

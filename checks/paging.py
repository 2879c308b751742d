from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import CHECKS, EV, MIXED, T_MS, check
from sigtrail.adapters import as_entries, events, int_entries, mixed_entries, state_entries
from sigtrail.functions.transfer import pack_transfer
from sigtrail.functions.typing import tagged
from sigtrail.operators import paging
from sigtrail.operators.filters import EntryFilter
from sigtrail.plans.ordered import position, value_at
from sigtrail.session import scratch_path
from sigtrail.sinks.sorted import write_sorted


def packed_events(spark, sf):
    """Events as packed transfer values with unique ids."""
    k = F.col("k").cast("string")
    fields = [k, F.col("signal"), F.concat(F.lit("S"), k), F.col("device_id"), F.col("category"), F.lit("OK")]
    rows = events(spark, sf).withColumn("_p", pack_transfer(fields)).withColumn("signal", F.lit("Transfer"))
    return as_entries(rows, tagged(string=F.col("_p")))


# A sort is compared as pages: which rows each sixth of the sorted table holds.
PAGES = 6


def page_sql(order: str, pages: int = PAGES) -> str:
    return f"(row_number() OVER (ORDER BY {order}) - 1) // CAST(ceil(count(*) OVER () / {pages}.0) AS BIGINT) AS page"


def page_size(rows, pages: int = PAGES) -> int:
    return max(1, -(-rows.count() // pages))


def all_pages(rows, column, direction="asc", count=PAGES):
    size = page_size(rows, count)
    placed = paging.sorted_rows(rows, column, direction) if count * size > paging.SHALLOW_ROWS else None
    pages = [paging.page_rows(rows, column, direction, n + 1, size, placed).withColumn("page", F.lit(n).cast("long")) for n in range(count)]
    return reduce(DataFrame.unionAll, pages)


def gaps(spark, sf):
    """Integer entries of which every third has no value."""
    rows = int_entries(spark, sf)
    return rows.withColumn("val_int", F.when(F.col("id") % 3 != 0, F.col("val_int")))


GAPS = EV + ", gaps AS (SELECT *, CASE WHEN id % 3 <> 0 THEN k END AS v FROM ev)"


@check(f"WITH {EV} SELECT id, ts_ms, signal, {page_sql('signal DESC, id DESC')} FROM ev")
def sort_by_signal(spark, sf):
    return all_pages(int_entries(spark, sf), "signalName", "desc").select("id", "ts_ms", "signal", "page")


@check(f"WITH {EV} SELECT id, {page_sql('category, id')} FROM ev")
def sort_by_category(spark, sf):
    return all_pages(int_entries(spark, sf), "category").select("id", "page")


@check(f"WITH {EV} SELECT id, {page_sql('ts_ms DESC, id DESC')} FROM ev")
def sort_by_time_descending(spark, sf):
    return all_pages(int_entries(spark, sf), "timestamp", "desc").select("id", "page")


# What the packed fields of ``packed_events`` hold.
PACKED = {"cmdID": "CAST(k AS VARCHAR)", "status": "signal", "source": "'S' || k", "dest": "device_id", "currLoc": "category", "result": "'OK'"}


@check(" UNION ALL ".join(f"(WITH {EV} SELECT '{name}' AS field, id, {page_sql(f'{text}, id', 4)} FROM ev)" for name, text in PACKED.items()))
def sort_by_transfer_fields(spark, sf):
    rows = packed_events(spark, sf)
    return reduce(DataFrame.unionAll, [all_pages(rows, name, count=4).select(F.lit(name).alias("field"), "id", "page") for name in PACKED])


@check(f"WITH {EV} SELECT id, k, device_id, {page_sql('device_id, id')} FROM ev")
def sort_by_dest(spark, sf):
    number = F.split_part("val_str", F.lit("|"), F.lit(1)).cast("long")
    return all_pages(packed_events(spark, sf), "dest").select("id", number.alias("k"), "device_id", "page")


@check(f"WITH {MIXED} SELECT id, signal, {page_sql("CASE val_type WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' ELSE 'string' END, id")} FROM mixed")
def sort_by_type(spark, sf):
    return all_pages(mixed_entries(spark, sf), "signalType").select("id", "signal", "page")


@check(f"WITH {EV} SELECT id, k, {page_sql('CAST(k AS VARCHAR) DESC, id DESC')} FROM ev")
def sort_by_value(spark, sf):
    return all_pages(int_entries(spark, sf), "value", "desc").select("id", F.col("val_int").alias("k"), "page")


def places(rows, column, direction="asc"):
    """Every row of the sorted table with its place in it."""
    ordered = paging.sort_entries(rows, column, direction).select("id", F.monotonically_increasing_id().alias("at"))
    return position(ordered, [], ["at"], "place").select("id", "place")


def place_sql(order: str) -> str:
    return f"row_number() OVER (ORDER BY {order}) - 1 AS place"


@check(" UNION ALL ".join(f"(WITH {EV} SELECT '{name}' AS field, id, {place_sql(f'{text} DESC, id DESC')} FROM ev)" for name, text in {"timestamp": "ts_ms", "deviceId": "device_id", "signalName": "signal", "category": "category"}.items()))
def sorted_by_column(spark, sf):
    rows = int_entries(spark, sf)
    return reduce(DataFrame.unionAll, [places(rows, name, "desc").select(F.lit(name).alias("field"), "id", "place") for name in paging.SORT_COLUMNS])


@check(" UNION ALL ".join(f"(WITH {EV} SELECT '{name}' AS field, id, {place_sql(f'{text}, id')} FROM ev)" for name, text in PACKED.items()))
def sorted_by_transfer_field(spark, sf):
    rows = packed_events(spark, sf)
    return reduce(DataFrame.unionAll, [places(rows, name).select(F.lit(name).alias("field"), "id", "place") for name in PACKED])


@check(f"""(WITH {GAPS} SELECT 'value' AS field, id, {place_sql("CAST(v AS VARCHAR) DESC NULLS LAST, id DESC")} FROM gaps)
UNION ALL (WITH {MIXED} SELECT 'signalType', id, {place_sql("CASE val_type WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' ELSE 'string' END DESC, id DESC")} FROM mixed)""")
def sorted_by_value_and_type(spark, sf):
    sorts = {"value": gaps(spark, sf), "signalType": mixed_entries(spark, sf)}
    return reduce(DataFrame.unionAll, [places(rows, name, "desc").select(F.lit(name).alias("field"), "id", "place") for name, rows in sorts.items()])


@check(f"WITH {EV} SELECT id FROM ev ORDER BY id LIMIT 2000 OFFSET 2000")
def page_large(spark, sf):
    return paging.page_rows(int_entries(spark, sf), "timestamp", "asc", 2, 2000).select("id")


def walk(rows, direction):
    """All pages, each found from the last row of the one before."""
    key, size, last, pages = paging.sort_expression("value"), page_size(rows), None, []
    for n in range(PAGES):
        page = paging.page_after(rows, "value", *last, size=size, direction=direction) if n else paging.page_rows(rows, "value", direction, 1, size)
        pages.append(page.select("id", F.col("val_int").alias("v"), F.lit(n).cast("long").alias("page")))
        ends = page.select(key.alias("key"), "source_id", "id").tail(1)
        if not ends:
            break
        last = tuple(ends[0])
    return reduce(DataFrame.unionAll, pages)


@check(f"WITH {GAPS} SELECT id, v, {page_sql('CAST(v AS VARCHAR) ASC NULLS LAST, id')} FROM gaps")
def page_after_null_keys(spark, sf):
    return walk(gaps(spark, sf), "asc")


@check(f"WITH {GAPS} SELECT id, v, {page_sql('CAST(v AS VARCHAR) DESC NULLS LAST, id DESC')} FROM gaps")
def page_after_null_keys_descending(spark, sf):
    return walk(gaps(spark, sf), "desc")


def late_time(rows):
    """The discrete 99 % quantile of the times."""
    return value_at(rows, "ts_ms", max(-(-rows.count() * 99 // 100) - 1, 0))


@check(" UNION ALL ".join(
    f"(WITH {GAPS}, r AS (SELECT ts_ms, row_number() OVER (ORDER BY CAST(v AS VARCHAR) {d} NULLS LAST, id {d}) - 1 AS i FROM gaps) SELECT '{d}' AS direction, coalesce(min(i), -1) AS row_index FROM r WHERE ts_ms >= (SELECT quantile_disc(ts_ms, 0.99) FROM ev))"
    for d in ("asc", "desc")
))
def index_of_time_null_keys(spark, sf):
    rows = gaps(spark, sf)
    late = late_time(rows)
    found = [paging.index_of_time(rows, late, column="value", direction=d).select(F.lit(d).alias("direction"), "row_index") for d in ("asc", "desc")]
    return reduce(DataFrame.unionAll, found)


@check(f"WITH {EV}, f AS (SELECT * FROM ev WHERE signal = 'error') SELECT id, ts_ms, device_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts_ms, id LIMIT 50 OFFSET 100")
def page_with_total(spark, sf):
    rows, total = paging.page(
        int_entries(spark, sf), EntryFilter(signal_names=("error",)), number=3, size=50
    )
    return rows.select("id", "ts_ms", "device_id", F.lit(total).cast("long").alias("total"))


@check(f"WITH {EV}, f AS (SELECT * FROM ev) SELECT id, device_id FROM f ORDER BY device_id, id LIMIT 100 OFFSET 200")
def page_after_key(spark, sf):
    entries = int_entries(spark, sf)
    last = paging.page_rows(entries, "deviceId", "asc", 2, 100).orderBy("device_id", "id").tail(1)[0]
    rows = paging.page_after(entries, "deviceId", last["device_id"], last["source_id"], last["id"])
    return rows.select("id", "device_id")


@check(f"WITH {EV} SELECT id, ts_ms, signal FROM ev ORDER BY id LIMIT 300 OFFSET 250")
def rows_in_range(spark, sf):
    return paging.entries_range(int_entries(spark, sf), 250, 550).select("id", "ts_ms", "signal")


@check(f"WITH {EV}, r AS (SELECT ts_ms, row_number() OVER (ORDER BY ts_ms, id) - 1 AS i FROM ev WHERE signal = 'view') SELECT coalesce(min(i), -1) AS row_index FROM r WHERE ts_ms >= {T_MS}")
def index_of_time(spark, sf):
    return paging.index_of_time(int_entries(spark, sf), T_MS, EntryFilter(signal_names=("view",)))


@check(f"WITH {EV}, r AS (SELECT ts_ms, row_number() OVER (ORDER BY device_id DESC, id DESC) - 1 AS i FROM ev) SELECT coalesce(min(i), -1) AS row_index FROM r WHERE ts_ms >= {T_MS}")
def index_of_time_descending(spark, sf):
    return paging.index_of_time(int_entries(spark, sf), T_MS, column="deviceId", direction="desc")


@check(f"WITH {EV} SELECT CAST(CASE WHEN max(ts_ms) >= 4000000000000 THEN 0 ELSE -1 END AS BIGINT) AS row_index FROM ev")
def index_past_end(spark, sf):
    return paging.index_of_time(int_entries(spark, sf), 4_000_000_000_000)


@check(f"""WITH {EV}, p AS (SELECT *, lag(signal) OVER (PARTITION BY device_id ORDER BY ts_ms, id) AS before FROM ev)
SELECT id, ts_ms, device_id, signal AS val_str FROM p WHERE before IS DISTINCT FROM signal""")
def changed_only(spark, sf):
    rows = paging.changed_only(state_entries(spark, sf))
    return rows.select("id", "ts_ms", "device_id", "val_str")


@check(f"WITH {GAPS} SELECT 'asc' AS direction, id, {page_sql('CAST(v AS VARCHAR) ASC NULLS LAST, id')} FROM gaps UNION ALL (WITH {GAPS} SELECT 'desc', id, {page_sql('CAST(v AS VARCHAR) DESC NULLS LAST, id DESC')} FROM gaps)")
def directory_pages(spark, sf):
    """All pages of a sorted copy, each read from the files that hold it."""
    rows = gaps(spark, sf)
    kept = write_sorted(rows, scratch_path(spark, "sorted"), "value", rows_per_file=max(1, rows.count() // 16))
    size = page_size(rows)
    pages = [kept.page(n + 1, size, d)[0].select(F.lit(d).alias("direction"), "id", F.lit(n).cast("long").alias("page")) for d in ("asc", "desc") for n in range(PAGES)]
    return reduce(DataFrame.unionAll, pages)


@check(CHECKS["index_of_time_null_keys"].sql)
def directory_index_of_time(spark, sf):
    rows = gaps(spark, sf)
    kept = write_sorted(rows, scratch_path(spark, "sorted"), "value", rows_per_file=max(1, rows.count() // 16))
    late = late_time(rows)
    return spark.createDataFrame([(d, kept.index_of_time(late, d)) for d in ("asc", "desc")], "direction string, row_index long")

"""Sorting, paging, positions and change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.functions.transfer import transfer_field
from sigtrail.functions.values import signal_type, value_struct, value_text
from sigtrail.operators.filters import EntryFilter
from sigtrail.plans.ordered import PlacedRows, previous
from sigtrail.schema import INGEST_ORDER, SIGNAL_KEY, TIME_ORDER

# Sortable names. The packed transfer fields sort by their text.
SORT_COLUMNS = {
    "timestamp": "ts_ms", "deviceId": "device_id", "signalName": "signal", "category": "category",
}
TRANSFER_SORTS = {
    "cmdID": "cmd_id", "status": "status", "source": "source",
    "dest": "dest", "currLoc": "curr_loc", "result": "result",
}
DEFAULT_PAGE_SIZE = 100
# Offsets up to here are served by a top-k; further ones by places in the sorted table.
SHALLOW_ROWS = 100_000


def sort_expression(name: str) -> Column:
    if name in TRANSFER_SORTS:
        return transfer_field(F.col("val_str"), TRANSFER_SORTS[name])
    if name == "value":
        return value_text()
    if name == "signalType":
        return signal_type()
    return F.col(SORT_COLUMNS.get(name, "ts_ms"))


def _ordering(key: Column, direction: str) -> list[Column]:
    if direction == "desc":
        return [key.desc_nulls_last(), *[F.col(c).desc() for c in INGEST_ORDER]]
    return [key.asc_nulls_last(), *[F.col(c).asc() for c in INGEST_ORDER]]


def sort_entries(entries: DataFrame, column: str = "timestamp", direction: str = "asc") -> DataFrame:
    return entries.orderBy(*_ordering(sort_expression(column), direction))


def _page_start(number: int, size: int) -> int:
    """First position of a page; numbers below 1 count as 1."""
    if size < 1:
        raise ValueError(f"a page has at least one row, not {size}")
    return (max(number, 1) - 1) * size


def page(
    entries: DataFrame,
    flt: EntryFilter | None = None,
    column: str = "timestamp",
    direction: str = "asc",
    number: int = 1,
    size: int = DEFAULT_PAGE_SIZE,
) -> tuple[DataFrame, int]:
    """One page of the filtered, sorted rows and the total they are taken from."""
    rows = entries.filter(flt.predicate()) if flt else entries
    return page_rows(rows, column, direction, number, size), rows.count()


def sorted_rows(rows: DataFrame, column: str, direction: str = "asc") -> PlacedRows:
    """The sorted table, written once, for many deep pages of it."""
    return PlacedRows(rows, _ordering(sort_expression(column), direction))


def page_rows(
    rows: DataFrame, column: str, direction: str, number: int, size: int, placed: PlacedRows | None = None
) -> DataFrame:
    """One page of the sorted rows.  Pages beyond ``SHALLOW_ROWS`` sort the whole table;
    ``placed`` is its ``sorted_rows``, where several of them are taken."""
    start = _page_start(number, size)
    if placed is None and start + size <= SHALLOW_ROWS:
        ordering = _ordering(sort_expression(column), direction)
        return rows.orderBy(*ordering).offset(start).limit(size)
    return (placed or sorted_rows(rows, column, direction)).between(start, start + size)


def page_after(
    entries: DataFrame,
    column: str,
    last_key,
    last_source: str,
    last_id: int,
    size: int = DEFAULT_PAGE_SIZE,
    direction: str = "asc",
) -> DataFrame:
    """The page that follows a known last row: a range predicate and a top-k,
    at the same cost for every depth.

    Rows without a key come last in both directions; ``last_key`` is None when the
    known row is one of them.
    """
    _page_start(1, size)
    key = sort_expression(column)
    here = F.struct(F.col("source_id").alias("s"), F.col("id").alias("i"))
    last = F.struct(F.lit(last_source).alias("s"), F.lit(last_id).cast("long").alias("i"))
    tied = here < last if direction == "desc" else here > last
    if last_key is None:
        later = key.isNull() & tied
    else:
        # Plain comparisons on the key are what the scan can use.
        bound = F.lit(last_key)
        beyond = key < bound if direction == "desc" else key > bound
        later = beyond | ((key == bound) & tied) | key.isNull()
    return entries.filter(later).orderBy(*_ordering(key, direction)).limit(size)


def entries_range(entries: DataFrame, start: int, end: int) -> DataFrame:
    """Rows ``start <= position < end`` in ingest order."""
    if end <= start:
        return entries.limit(0)
    if end <= SHALLOW_ROWS:
        return entries.orderBy(*INGEST_ORDER).offset(start).limit(end - start)
    return PlacedRows(entries, INGEST_ORDER).between(start, end)


def index_of_time(
    entries: DataFrame,
    ts_ms: int,
    flt: EntryFilter | None = None,
    column: str = "timestamp",
    direction: str = "asc",
) -> DataFrame:
    """0-based index, in the sorted rows, of the first row at or after ``ts_ms``; -1 if none.

    The first such row is an aggregate and its index is the number of rows
    sorted before it, so nothing is ranked.
    """
    rows = entries.filter(flt.predicate()) if flt else entries
    # NULL keys sort last in both directions, which a struct would put first.
    value = sort_expression(column)
    flag = value.isNotNull() if direction == "desc" else value.isNull()
    key = F.struct(flag.alias("f"), value.alias("k"), *INGEST_ORDER)
    reached = F.col("ts_ms") >= ts_ms
    edge = F.max if direction == "desc" else F.min
    first = rows.filter(reached).agg(edge(key).alias("first")).scalar()
    before = key > first if direction == "desc" else key < first
    return rows.agg(
        F.when(F.max(F.when(reached, 1)) == 1, F.count_if(F.coalesce(before, F.lit(False))))
        .otherwise(F.lit(-1))
        .cast("long")
        .alias("row_index")
    )


def changed_only(entries: DataFrame, segments: int | None = None) -> DataFrame:
    """Rows whose value differs from the previous row of their signal; the first is kept."""
    columns: Sequence[str] = entries.columns
    rows = previous(
        entries, SIGNAL_KEY, TIME_ORDER, {"_before": value_struct()}, segments=segments
    )
    return rows.filter(~F.col("_before").eqNullSafe(value_struct())).select(*columns)

"""Entries kept in a sort order, with a directory of where which positions are.

Rows are range partitioned and sorted once, so a file holds consecutive positions.  The
directory has a row for each file and kind of key (present or NULL): how many rows,
where they begin, and the largest time among them.  A page then reads the one or two
files that hold its positions, and the index of a time reads the first file that has a
row at or after it, at every depth of the table.

Rows without a key come last in both directions, so descending order is the reverse of
the rows with a key, followed by the reverse of those without.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtrail.operators import paging
from sigtrail.operators.filters import EntryFilter
from sigtrail.schema import ENTRY_COLUMNS, ENTRY_SCHEMA, INGEST_ORDER
from sigtrail.session import cut_lineage, drop_stage

ROWS_PER_FILE = 1_000_000
INGEST = "ingest"
"""The order of lines in their sources, besides the names that ``paging`` sorts by."""
_DIRECTORY = "file string, missing int, rows long, first long, latest long, total long, present long, column string"


def _key(column: str) -> Column:
    return F.lit(0).cast("long") if column == INGEST else paging.sort_expression(column)


class SortedEntries(NamedTuple):
    spark: SparkSession
    path: str
    column: str
    total: int
    present: int
    """Rows that have a key."""

    def _directory(self) -> DataFrame:
        return self.spark.read.schema(_DIRECTORY).parquet(f"{self.path}/directory").filter(F.col("rows") > 0)

    def _pieces(self, first: int, end: int) -> list:
        overlap = (F.col("first") < end) & (F.col("first") + F.col("rows") > first)
        return self._directory().filter(overlap).orderBy("first").select("file", "first").collect()  # those a page lies in

    def _ascending(self, first: int, end: int) -> DataFrame:
        """Rows of ascending positions ``first <= position < end``, in order."""
        pieces = self._pieces(first, end) if first < end else []
        if not pieces:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        files = list(dict.fromkeys(p["file"] for p in pieces))
        base = self._directory().filter(F.col("file").isin(files)).agg(F.min("first")).first()[0]
        return self._read(files).orderBy(*self._order("asc")).offset(first - base).limit(end - first)

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(ENTRY_SCHEMA).parquet(*[f"{self.path}/entries/{f}" for f in files])

    def _order(self, direction: str) -> list[Column]:
        return paging._ordering(_key(self.column), direction)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY_SCHEMA).parquet(f"{self.path}/entries")

    def rows(self, start: int, end: int, direction: str = "asc") -> DataFrame:
        """Rows ``start <= position < end`` of the sorted table, in order."""
        start, end = max(start, 0), min(end, self.total)
        if direction != "desc":
            return self._ascending(start, end)
        with_key = self._ascending(self.present - min(end, self.present), self.present - min(start, self.present))
        low, high = max(start, self.present), max(end, self.present)
        without = self._ascending(self.total - (high - self.present), self.total - (low - self.present))
        return with_key.unionByName(without).orderBy(*self._order("desc"))

    def page(self, number: int = 1, size: int = paging.DEFAULT_PAGE_SIZE, direction: str = "asc", flt: EntryFilter | None = None) -> tuple[DataFrame, int]:
        """As ``paging.page``; positions of filtered rows are not in the directory, so
        with a filter the page is found in the rows themselves."""
        if flt is not None:
            return paging.page(self.entries(), flt, self.column, direction, number, size)
        start = paging._page_start(number, size)
        return self.rows(start, start + size, direction), self.total

    def index_of_time(self, ts_ms: int, direction: str = "asc", flt: EntryFilter | None = None) -> int:
        """As ``paging.index_of_time``, from one file."""
        if flt is not None:
            return paging.index_of_time(self.entries(), ts_ms, flt, self.column, direction).first()[0]
        late = self._directory().filter(F.col("latest") >= ts_ms)
        order = [F.col("missing"), F.col("first").desc()] if direction == "desc" else [F.col("first")]
        piece = late.orderBy(*order).first()
        if piece is None:
            return -1
        own = _key(self.column).isNull() if piece["missing"] else _key(self.column).isNotNull()
        within = paging.index_of_time(self._read([piece["file"]]).filter(own), ts_ms, None, "timestamp" if self.column == INGEST else self.column, direction)
        if self.column == INGEST:
            within = self._index_in_ingest_order(piece["file"], ts_ms, direction)
        else:
            within = within.first()[0]
        if direction != "desc":
            return piece["first"] + within
        last = self.total if piece["missing"] else self.present
        return (self.present if piece["missing"] else 0) + last - piece["first"] - piece["rows"] + within

    def _index_in_ingest_order(self, file: str, ts_ms: int, direction: str) -> int:
        rows, here = self._read([file]), F.struct(*INGEST_ORDER)
        reached = rows.filter(F.col("ts_ms") >= ts_ms).agg((F.max(here) if direction == "desc" else F.min(here)).alias("row")).first()["row"]
        found = F.struct(F.lit(reached["source_id"]).alias("source_id"), F.lit(reached["id"]).cast("long").alias("id"))
        return rows.filter(here > found if direction == "desc" else here < found).count()


def open_sorted(spark: SparkSession, path: str) -> SortedEntries:
    known = spark.read.schema(_DIRECTORY).parquet(f"{path}/directory").first()
    return SortedEntries(spark, path, known["column"], known["total"], known["present"])


def write_sorted(entries: DataFrame, path: str, column: str = "timestamp", rows_per_file: int = ROWS_PER_FILE) -> SortedEntries:
    """Write ``entries`` in the order of ``column`` (a name of ``paging``, or ``INGEST``)
    and its directory, which is written last."""
    spark = entries.sparkSession
    rows = cut_lineage(entries.select(*ENTRY_COLUMNS))
    files = max(1, -(-rows.count() // rows_per_file))
    order = paging._ordering(_key(column), "asc")
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/entries")
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    written = spark.read.schema(ENTRY_SCHEMA).parquet(f"{path}/entries").select("*", name.alias("file"))
    key = F.struct(_key(column).alias("key"), *INGEST_ORDER)
    pieces = written.groupBy("file", _key(column).isNull().cast("int").alias("missing")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(key).alias("_low"), F.max("ts_ms").alias("latest")
    )
    # A row for each file and kind of key.
    before = Window.orderBy("missing", "_low").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    directory = pieces.select(
        "file", "missing", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), "latest",
        F.sum("rows").over(every).alias("total"), F.coalesce(F.sum(F.when(F.col("missing") == 0, F.col("rows"))).over(every), F.lit(0)).alias("present"),
    )
    none = spark.createDataFrame([("", 0, 0, 0, None, 0, 0)], directory.schema)
    placed = directory if rows.limit(1).count() else none
    placed.withColumn("column", F.lit(column)).coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")
    drop_stage(rows)
    return open_sorted(spark, path)

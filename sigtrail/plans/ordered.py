"""Order-dependent columns that survive hot keys.

``lag``, "last known value" and running totals need the rows of a key in
order.  A plain window does that with one shuffle, but puts a whole key into
one task; with a key that holds a third of the data that task never finishes.

Here a key with more rows than one task should sort is cut into consecutive
*segments* of about equal size: its rows are range partitioned by ``(keys, order)``
into as many parts as their number asks for, and the part becomes a column of the
rows, which are written once so that every branch of the plan agrees on it, whatever
is recomputed.  Each segment is windowed on its own, and what a segment needs from
the rows before it (last row, last known value, total so far) comes from a
per-segment summary, at most two rows for each cut.

Keys that fit a task are one segment and are not ranged; if all do, nothing is
written and the plain window is taken.  The choice is one counting job.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.session import cut_lineage

ROWS_PER_TASK_CONF = "spark.sigtrail.maxRowsPerTask"
DEFAULT_ROWS_PER_TASK = 4_000_000
_SEG = "_segment"
_AT = "_at"
# ``monotonically_increasing_id`` numbers the rows of a task in so many low bits.
_TASK_BITS = 33


def rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_TASK_CONF, str(DEFAULT_ROWS_PER_TASK)))


def count_not_above(sorted_values: Column, size: int, probe: Column) -> Column:
    """How many of the ascending ``sorted_values`` are <= ``probe`` (binary search)."""
    steps = [1 << k for k in range(max(size, 1).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when(
            (pos + step <= size) & (F.get(sorted_values, pos + step - 1) <= probe), pos + step
        ).otherwise(pos),
    )


class OrderedRows:
    """``df`` seen per key in ascending order, cut into segments where needed."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        segments: int | None = None,
        within: DataFrame | None = None,
    ) -> None:
        """``within`` is a frame with at least as many rows as any key of ``df``: where
        counting it is cheaper and already shows that a key fits, ``df`` is not counted."""
        self.keys = list(keys)
        self.order = list(order)
        cut = self._cut(df, segments, df if within is None else within)
        self.segmented = cut is not None
        self.df = cut if self.segmented else df

    # -- cutting -----------------------------------------------------------

    def _cut(self, df: DataFrame, segments: int | None, within: DataFrame) -> DataFrame | None:
        """``df`` with its segments, or None where no key needs more than one."""
        if segments == 1:
            return None
        if segments is not None:
            return cut_lineage(self._ranged(df, segments))
        limit = rows_per_task(df)
        # A plain count reads no columns, so it goes first.
        if within.count() <= limit:
            return None
        if not self.keys:
            total = df.count()
            return cut_lineage(self._ranged(df, math.ceil(2 * total / limit))) if total > limit else None
        hot = df.groupBy(*self.keys).count().filter(F.col("count") > limit)
        total = hot.agg(F.sum("count")).first()[0]
        if not total:
            return None
        hot = cut_lineage(hot.select(*self.keys))  # at most one key for each ``limit`` rows
        ranged = self._ranged(df.join(hot, self.keys, "left_semi"), math.ceil(2 * total / limit))
        rest = df.join(hot, self.keys, "left_anti").withColumn(_SEG, F.lit(0))
        return cut_lineage(ranged.unionByName(rest))

    def _ranged(self, rows: DataFrame, parts: int) -> DataFrame:
        """Twice as many parts as the limit asks for: their sizes are estimates."""
        ranged = rows.repartitionByRange(parts, *self.keys, *self.order)
        return ranged.withColumn(_SEG, F.spark_partition_id())

    # -- windows -----------------------------------------------------------

    def _window(self, backward: bool):
        partition = self.keys + ([_SEG] if self.segmented else [])
        order = [F.col(c).desc() if backward else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*partition).orderBy(*order)

    def _segment_window(self, backward: bool):
        seg = F.col(_SEG).desc() if backward else F.col(_SEG).asc()
        return Window.partitionBy(*self.keys).orderBy(seg)

    def _summaries(self, *aggregates: Column) -> DataFrame:
        """One row per (key, segment) of the keys that span several segments."""
        spans = F.count(F.lit(1)).over(Window.partitionBy(*self.keys))
        return (
            self.df.groupBy(*self.keys, _SEG)
            .agg(*aggregates)
            .withColumn("_spans", spans)
            .filter("_spans > 1")
            .drop("_spans")
        )

    def _position(self) -> Column:
        return F.struct(*self.order)

    def _replace(self, df: DataFrame) -> OrderedRows:
        other = object.__new__(OrderedRows)
        other.keys, other.order, other.segmented = self.keys, self.order, self.segmented
        other.df = df
        return other

    # -- the rows, seen the same way -----------------------------------------

    def with_column(self, name: str, value: Column) -> OrderedRows:
        return self._replace(self.df.withColumn(name, value))

    def filter(self, condition: Column) -> OrderedRows:
        """A subset needs no new cut: its keys are at most as large."""
        return self._replace(self.df.filter(condition))

    def settle(self) -> OrderedRows:
        """Write the rows once where several later branches would recompute them."""
        return self._replace(cut_lineage(self.df)) if self.segmented else self

    # -- public columns ----------------------------------------------------

    def neighbour(self, values: Mapping[str, Column], backward: bool = False) -> OrderedRows:
        """Columns of the previous row (``backward``: the next row) of the key."""
        payload = F.struct(*[v.alias(n) for n, v in values.items()])
        near = F.lag(payload).over(self._window(backward))
        if not self.segmented:
            out = self.df.withColumn("_near", near)
        else:
            edge = F.min_by if backward else F.max_by
            carry = self._summaries(edge(payload, self._position()).alias("_edge")).select(
                *self.keys, _SEG, F.lag("_edge").over(self._segment_window(backward)).alias("_carry")
            )
            joined = self.df.withColumn("_near", near).join(
                carry, [*self.keys, _SEG], "left"
            )
            out = joined.withColumn("_near", F.coalesce("_near", "_carry")).drop("_carry")
        out = out.select("*", *[F.col(f"_near.{n}").alias(n) for n in values]).drop("_near")
        return self._replace(out)

    def known(self, values: Mapping[str, Column], backward: bool = False) -> OrderedRows:
        """Last non-null value at or before the row (``backward``: first at or after)."""
        frame = self._window(backward).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {n: F.last(v, ignorenulls=True).over(frame) for n, v in values.items()}
        if not self.segmented:
            return self._replace(self.df.withColumns(local))
        edge = F.min_by if backward else F.max_by
        earlier = self._segment_window(backward).rowsBetween(Window.unboundedPreceding, -1)
        summary = self._summaries(
            *[
                edge(v, F.when(v.isNotNull(), self._position())).alias(f"_edge_{n}")
                for n, v in values.items()
            ]
        )
        carry = summary.select(
            *self.keys,
            _SEG,
            *[F.last(f"_edge_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in values],
        )
        out = self.df.withColumns(local).join(carry, [*self.keys, _SEG], "left")
        out = out.withColumns({n: F.coalesce(n, f"_carry_{n}") for n in values})
        return self._replace(out.drop(*[f"_carry_{n}" for n in values]))

    def running_total(self, values: Mapping[str, Column]) -> OrderedRows:
        """Sum of the values up to and including the row."""
        frame = self._window(False).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {n: F.sum(v).over(frame) for n, v in values.items()}
        if not self.segmented:
            return self._replace(self.df.withColumns(local))
        earlier = self._segment_window(False).rowsBetween(Window.unboundedPreceding, -1)
        summary = self._summaries(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
        carry = summary.select(
            *self.keys,
            _SEG,
            *[F.sum(f"_sum_{n}").over(earlier).alias(f"_carry_{n}") for n in values],
        )
        out = self.df.withColumns(local).join(carry, [*self.keys, _SEG], "left")
        out = out.withColumns(
            {n: F.col(n) + F.coalesce(f"_carry_{n}", F.lit(0)) for n in values}
        )
        return self._replace(out.drop(*[f"_carry_{n}" for n in values]))

    def frame(self) -> DataFrame:
        return self.df.drop(_SEG)


def previous(df, keys, order, values, segments=None) -> DataFrame:
    return OrderedRows(df, keys, order, segments).neighbour(values).frame()


def following(df, keys, order, values, segments=None) -> DataFrame:
    return OrderedRows(df, keys, order, segments).neighbour(values, backward=True).frame()


def position(df, keys, order, name="pos", segments=None) -> DataFrame:
    """Dense 0-based position of each row inside its key."""
    rows = OrderedRows(df, keys, order, segments).running_total({name: F.lit(1).cast("long")})
    return rows.frame().withColumn(name, F.col(name) - 1)


class PlacedRows:
    """All rows in one order, written once, of which any range of places is read.

    Their numbers come from the tasks of the sort, so they grow in that order, and the
    rows of each task, a few numbers in all, tell which is at a place.  Reading a range
    is a filter on the number, which skips the files and row groups outside it.
    """

    def __init__(self, rows: DataFrame, order: Sequence[Column | str]) -> None:
        self.columns = rows.columns
        self.df = cut_lineage(rows.orderBy(*order).withColumn(_AT, F.monotonically_increasing_id()))
        task = F.shiftright(_AT, _TASK_BITS).alias("task")
        self._tasks = self.df.groupBy(task).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()

    def _number(self, place: int) -> int | None:
        """The number of the row at a place; None past the end."""
        for task, n in self._tasks:
            if place < n:
                return (task << _TASK_BITS) + place
            place -= n
        return None

    def between(self, start: int, end: int) -> DataFrame:
        """Rows ``start <= place < end``, in order."""
        first, stop = self._number(max(start, 0)), self._number(max(end, 0))
        wanted = self.df.filter(F.lit(False) if first is None else F.col(_AT) >= first)
        if stop is not None:
            wanted = wanted.filter(F.col(_AT) < stop)
        return wanted.orderBy(_AT).select(*self.columns)


def value_at(df: DataFrame, column: str, place: int):
    """The value at a 0-based place of a column in ascending order, NULLs first."""
    return PlacedRows(df.select(column), [column]).between(place, place + 1).first()[0]

"""Sharding by histogram sort.

Rows are put in the order of a 64-bit key and the order is cut into shards of nearly
equal bytes.  The cuts are found without moving a row: every round counts, exactly and
in all partitions, the bytes below a set of probe keys, and the next probes divide the
intervals that still hold a cut.  When every cut is within the tolerance the rows are
exchanged once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.llm.scratch import as_row, from_row, of_row, staged
from sigtrail.plans.ordered import count_not_above

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
MOST_LARGE = 4096
"""Texts at most that are cut into runs of their own."""
PROBES = 64
"""Probes that divide one unresolved interval in one round."""


class Cut(NamedTuple):
    """Rows with ``key < at`` come before the cut; ``below`` is their bytes."""

    at: int
    below: int


def text_key(text: Column, *others: Column) -> Column:
    """High half from the text, low half from the other columns: equal texts are
    neighbours in the order, and a group of copies can still be cut."""
    high = F.shiftleft(F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF)), 32)
    return high.bitwiseOR(F.xxhash64(text, *others).bitwiseAND(F.lit(0xFFFFFFFF)))


def histogram(keyed: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key in [probe i - 1, probe i), for n + 1 intervals.

    ``keyed`` has ``key`` and ``size``, both long.  A task yields one row per interval
    that it has rows in.
    """
    edges = np.array(sorted(probes), dtype=np.int64)

    def count(batches):
        sizes, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(), side="right")
            np.add.at(sizes, at, batch.column(1).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        has = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(sizes[has]), pa.array(rows[has])], names=["at", "size", "n"])

    partial = keyed.select("key", "size").mapInArrow(count, "at long, size long, n long")
    sizes, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for at, size, n in partial.groupBy("at").agg(F.sum("size"), F.sum("n")).collect():  # one row per interval
        sizes[at], rows[at] = size, n
    return sizes, rows


def _between(low: int, high: int, n: int) -> list[int]:
    """Up to n keys strictly inside (low, high), evenly spread."""
    span = high - low
    return sorted({low + span * i // (n + 1) for i in range(1, n + 1)} - {low, high})


def splitters(keyed: DataFrame, shards: int, tolerance: int) -> list[int]:
    """``shards - 1`` keys that cut the order into parts of equal bytes.

    The bytes below a cut differ from its share by ``tolerance`` at most, or by what
    one key weighs, if that is more.  Six bits of the key are settled in a round at
    least, so there are 11 rounds at most, and two or three for hashed keys.
    """
    low = [Cut(LOWEST, 0)] * (shards - 1)
    high: list[Cut] = []
    done: dict[int, int] = {}
    probes = _between(LOWEST, HIGHEST, PROBES * shards)
    while True:
        sizes, _ = histogram(keyed, probes)
        below = np.cumsum(sizes)
        if not high:
            total = int(below[-1])
            high = [Cut(HIGHEST, total)] * (shards - 1)
        known = [Cut(p, int(b)) for p, b in zip(probes, below)]
        probes = []
        for i in range(shards - 1):
            want = total * (i + 1) // shards
            if i in done:
                continue
            low[i] = max([low[i], *(c for c in known if c.below <= want)], key=lambda c: (c.below, c.at))
            high[i] = min([high[i], *(c for c in known if c.below >= want)], key=lambda c: (c.below, c.at))
            best = min(low[i], high[i], key=lambda c: (abs(c.below - want), c.at))
            inside = _between(*sorted((low[i].at, high[i].at)), PROBES)
            if abs(best.below - want) <= tolerance or not inside:
                done[i] = best.at
            else:
                probes += inside
        if not probes:
            return [done[i] for i in range(shards - 1)]
        probes = sorted(set(probes))


def shard_column(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, by a binary search of nested conditions."""

    def search(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(key < F.lit(cuts[middle]), search(first, middle)).otherwise(search(middle + 1, last))

    return search(0, len(cuts))


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, text: str = "text", tie: tuple[str, ...] = ("doc_id",), rows_per_run: int = 50_000) -> DataFrame:
    """Every row of ``docs`` with its ``size``, ``shard`` and ``slot``.

    ``size`` is the UTF-8 bytes of the text plus 8; null counts as no text.  A shard's
    bytes differ from the mean by ``tolerance`` of it at most (each of its two cuts by
    half of that), or by one row.  ``slot`` numbers a shard's rows from 0 in key order.
    Copies of a text are neighbours; a group larger than a shard is cut by ``tie``.
    Rows that agree in text and ``tie`` are in no particular order among themselves;
    null ties are ties of their own.  Of the columns of ``docs`` only ones named like
    those three are replaced.  No rows give no rows.

    The one exchange deals shards out in runs of about ``rows_per_run`` rows, counted
    beforehand from the keys alone.  A run is a range of keys; where a text alone has
    more rows than a run, its copies are runs of their own, cut by the half of the key
    that comes from ``tie``.  So no task numbers a whole shard or all copies of a text,
    unless they agree in ``tie`` too.
    """
    rows = as_row(docs)
    key = text_key(of_row(text), *[of_row(c) for c in tie])
    size = (F.coalesce(F.octet_length(of_row(text)), F.lit(0)) + 8).cast("long")
    counted = staged(rows.select(key.alias("key"), size.alias("size")))
    total, number = counted.agg(F.sum("size"), F.count("*")).first()
    cuts = sorted(splitters(counted, shards, int((total or 0) / shards * tolerance / 2))) if number else [0] * (shards - 1)
    runs = max(1, -(-number // (shards * rows_per_run)))
    edges = F.array(*[F.lit(float(x)) for x in (LOWEST, *cuts, HIGHEST)])
    # Texts of more rows than this are few, whatever their size.
    most = max(rows_per_run, number // MOST_LARGE + 1)
    large = counted.groupBy(F.shiftright("key", 32).alias("high")).count().where(F.col("count") > most).orderBy("high").collect()
    highs, parts = [r["high"] for r in large], [-(-r["count"] // rows_per_run) for r in large]

    def place(df: DataFrame) -> DataFrame:
        df = df.withColumn("shard", shard_column(F.col("key"), cuts).cast("int"))
        low, high = F.get(edges, F.col("shard")), F.get(edges, F.col("shard") + 1)
        part = F.floor((F.col("key").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * runs)
        df = df.withColumn("run", F.greatest(F.lit(0), F.least(F.lit(runs - 1), part)).cast("long"))
        if not highs:
            return df.withColumns({"zone": F.lit(0), "piece": F.lit(0).cast("long")})
        own = F.shiftright("key", 32)
        table = F.array(*[F.lit(h) for h in highs])
        upto = count_not_above(table, len(highs), own)
        inside = F.coalesce(F.get(table, upto - 1) == own, F.lit(False))
        share = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)) * F.get(F.array(*[F.lit(n).cast("long") for n in parts]), upto - 1)
        return df.withColumns({"zone": 2 * upto - inside.cast("int"), "piece": F.when(inside, F.shiftright(share, 32)).otherwise(F.lit(0).cast("long"))})

    group = ["shard", "run", "zone", "piece"]
    before = Window.partitionBy("shard").orderBy(*group[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = place(counted).groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy(*group).orderBy("key", *[of_row(c) for c in tie])
    numbered = place(rows.withColumns({"key": key, "size": size})).withColumn("place", F.row_number().over(order) - 1)
    return numbered.join(offsets, group).select(*from_row(docs, "size", "shard", "slot"), "size", "shard", (F.col("place") + F.col("offset")).alias("slot"))

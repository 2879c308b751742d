"""As-of look-ups for many probe times.

A row at ``t`` can only answer probes at or after ``t``, and among the rows
between two neighbouring probes only the last (or first) of a key matters.  So
rows are aggregated into the slot between neighbouring probes - which happens
map-side, before any shuffle - and what is windowed afterwards has at most one
row per key and probe.

``MAX_SLOTS`` bounds the probe list that may ride along in the plan.  Beyond it
the probes are joined as rows: see ``asof_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.plans.ordered import OrderedRows, count_not_above

MAX_SLOTS = 10_000


class ProbeTimes:
    """The distinct probe times of a frame, if few enough to hold."""

    def __init__(self, probes: DataFrame, column: str = "t_ms", max_slots: int = MAX_SLOTS) -> None:
        distinct = probes.select(F.col(column).cast("long").alias("t")).distinct()
        found = [r[0] for r in distinct.limit(max_slots + 1).collect()]
        self.fits = len(found) <= max_slots
        self.times = sorted(found) if self.fits else []

    def array(self) -> Column:
        if not self.times:
            return F.array().cast("array<bigint>")
        text = ",".join(map(str, self.times))
        return F.split(F.lit(text), ",").cast("array<bigint>")

    def before_or_at(self, ts: Column) -> Column:
        """Index of the first probe at or after ``ts``; past the end when there is none."""
        # Probes < ts are those <= ts - 1 on whole milliseconds.
        return self.count_up_to(ts - 1)

    def count_up_to(self, ts: Column) -> Column:
        """Number of probes at or before ``ts``."""
        return count_not_above(self.array(), len(self.times), ts)

    def time_at(self, slot: Column) -> Column:
        return F.get(self.array(), slot)


def asof_rows(
    rows: DataFrame,
    probes: DataFrame,
    keys: list[str],
    order: list[str],
    payload: dict[str, Column],
    backward: bool = False,
    segments: int | None = None,
) -> DataFrame:
    """Probes (``keys``, ``t_ms``, anything else) with the payload of the last row
    at or before them (``backward``: the first at or after).

    Rows and probes are merged into one order; at equal times a probe sorts after
    the rows (before them when looking forward).
    """
    time, *ties = order
    extra = [c for c in probes.columns if c not in keys and c != "t_ms"]
    kinds = {f.name: f.dataType for f in rows.schema}
    value = F.struct(*[v.alias(n) for n, v in payload.items()])
    side = F.lit(0 if backward else 2)
    left = rows.select(
        *keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), *ties,
        value.alias("_value"), F.lit(None).alias("_probe"),
    )
    right = probes.select(
        *keys, F.col("t_ms").cast("long").alias("_t"), side.alias("_side"),
        *[_lowest(kinds[c]).alias(c) for c in ties],
        F.lit(None).alias("_value"), F.struct(F.col("t_ms"), *extra).alias("_probe"),
    )
    merged = OrderedRows(left.unionByName(right), keys, ["_t", "_side", *ties], segments)
    found = merged.known({"_value": F.col("_value")}, backward=backward).frame()
    hits = found.filter(F.col("_probe").isNotNull())
    return hits.select(
        *keys, "_probe.*", *[F.col(f"_value.{n}").alias(n) for n in payload]
    )


def _lowest(kind) -> Column:
    return F.lit("") if kind.simpleString() == "string" else F.lit(0).cast(kind)

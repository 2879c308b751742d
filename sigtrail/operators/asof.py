"""Time ranges, values at a time, boundaries and held states."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.functions.values import is_high
from sigtrail.operators.filters import EntryFilter, pair_filter, restrict_to_signals, split_pair
from sigtrail.plans.ordered import OrderedRows, following, position, previous
from sigtrail.plans.slots import ProbeTimes, asof_rows
from sigtrail.schema import ENTRY_COLUMNS, SIGNAL_KEY, TIME_ORDER
from sigtrail.session import cut_lineage

_REST = [c for c in ENTRY_COLUMNS if c not in SIGNAL_KEY]


def _row() -> Column:
    return F.struct(*_REST)


def _when() -> Column:
    return F.struct(*TIME_ORDER)


def _unpack(df: DataFrame, column: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[c if c in SIGNAL_KEY else F.col(f"{column}.{c}") for c in ENTRY_COLUMNS])


def _in_window(start_ms: int, end_ms: int) -> Column:
    return F.col("ts_ms").between(start_ms, end_ms)


def chunk(
    entries: DataFrame, start_ms: int, end_ms: int, signals=None, max_rows: int | None = None
) -> DataFrame:
    """Rows of ``[start, end]`` in time order, cut at ``max_rows`` only when asked."""
    rows = restrict_to_signals(entries.filter(_in_window(start_ms, end_ms)), signals)
    ordered = rows.orderBy(*TIME_ORDER)
    return ordered.limit(max_rows) if max_rows else ordered


def signal_entries(entries: DataFrame, signals) -> DataFrame:
    """Every row of the given signals in time order."""
    return restrict_to_signals(entries, signals).orderBy(*TIME_ORDER)


def _named(signals) -> Column | None:
    """``device::signal`` keys match one signal, a bare name matches it on all devices."""
    if not signals:
        return None
    names = [s for s in signals if split_pair(s) is None]
    return pair_filter([s for s in signals if split_pair(s)]) | F.col("signal").isin(names)


def values_at(entries: DataFrame, t_ms: int, signals: list[str] | None = None) -> DataFrame:
    """Latest row of every signal at or before ``t_ms``."""
    rows = entries.filter(F.col("ts_ms") <= t_ms)
    wanted = _named(signals)
    if wanted is not None:
        rows = rows.filter(wanted)
    latest = rows.groupBy(*SIGNAL_KEY).agg(F.max_by(_row(), _when()).alias("_row"))
    return _unpack(latest, "_row")


class HeldValues(NamedTuple):
    """Which probes see which row: those numbered ``_slot`` to ``_until`` see ``_row``.

    There is a row for each value that some probe sees, so their number grows with the
    changes of the log and not with that of the probes.
    """

    rows: DataFrame
    probe: ProbeTimes
    numbered: DataFrame | None

    def timed(self, df: DataFrame, slot: str, name: str) -> DataFrame:
        """``df`` with the time of the probe numbered ``slot`` in its place."""
        if self.numbered is None:
            return df.withColumn(name, self.probe.time_at(F.col(slot))).drop(slot)
        times = self.numbered.select(F.col("_slot").alias(slot), F.col("t_ms").alias(name))
        return df.join(times, slot).drop(slot)

    def expanded(self, df: DataFrame) -> DataFrame:
        """A row of ``df`` for each probe from ``_slot`` to ``_until``, with its ``t_ms``."""
        each = df.withColumn("_at", F.explode(F.sequence("_slot", "_until"))).drop("_slot", "_until")
        return self.timed(each, "_at", "t_ms")


def held_values(
    entries: DataFrame,
    times: DataFrame,
    signals: list[str] | None = None,
    segments: int | None = None,
    max_slots: int | None = None,
) -> HeldValues:
    """What every signal holds at each ``t_ms`` of ``times``, as ranges of probes."""
    wanted = _named(signals)
    rows = entries if wanted is None else entries.filter(wanted)
    probe = ProbeTimes(times, **({} if max_slots is None else {"max_slots": max_slots}))
    if not probe.fits:
        return _held_at_many(rows, times, segments, probe)
    if not probe.times:
        none = rows.limit(0).select(*SIGNAL_KEY, _row().alias("_row"))
        return HeldValues(none.withColumns({"_slot": F.lit(0), "_until": F.lit(0)}), probe, None)
    in_reach = rows.filter(F.col("ts_ms") <= probe.times[-1])
    latest = (
        in_reach.groupBy(*SIGNAL_KEY, probe.before_or_at(F.col("ts_ms")).alias("_slot"))
        .agg(F.max_by(_row(), _when()).alias("_row"))
    )
    # At most one row per signal and probe from here on.
    next_slot = F.lead("_slot").over(Window.partitionBy(*SIGNAL_KEY).orderBy("_slot"))
    until = F.coalesce(next_slot, F.lit(len(probe.times))) - 1
    return HeldValues(latest.withColumn("_until", until), probe, None)


def _held_at_many(rows: DataFrame, times: DataFrame, segments: int | None, probe: ProbeTimes) -> HeldValues:
    """The same slots for more probes than a plan can carry: the probes are numbered
    as a table and every row looks up the first probe at or after it."""
    asked = times.select(F.col("t_ms").cast("long").alias("t_ms")).distinct()
    numbered = cut_lineage(position(asked, [], ["t_ms"], "_slot", segments))
    total = numbered.agg(F.count(F.lit(1))).first()[0]
    placed = asof_rows(
        numbered.withColumnRenamed("t_ms", "_m"),
        rows.select(F.col("ts_ms").alias("t_ms"), F.struct(*ENTRY_COLUMNS).alias("_entry")),
        [],
        ["_m"],
        {"_slot": F.col("_slot")},
        backward=True,
        segments=segments,
    ).filter(F.col("_slot").isNotNull())
    entry = placed.select("_slot", "_entry.*")
    latest = entry.groupBy(*SIGNAL_KEY, "_slot").agg(F.max_by(_row(), _when()).alias("_row"))
    held = following(latest, SIGNAL_KEY, ["_slot"], {"_until": F.col("_slot")}, segments)
    return HeldValues(held.withColumn("_until", F.coalesce("_until", F.lit(total)) - 1), probe, numbered)


def values_at_times(
    entries: DataFrame,
    times: DataFrame,
    signals: list[str] | None = None,
    segments: int | None = None,
    max_slots: int | None = None,
) -> DataFrame:
    """``values_at`` for every ``t_ms`` of ``times``."""
    held = held_values(entries, times, signals, segments, max_slots)
    return _unpack(held.expanded(held.rows), "_row", "t_ms")


def value_ranges(
    entries: DataFrame,
    times: DataFrame,
    signals: list[str] | None = None,
    segments: int | None = None,
    max_slots: int | None = None,
) -> DataFrame:
    """``values_at_times`` with a row for each run of probes that see the same row:
    ``from_ms`` and ``to_ms`` are the first and last of them."""
    held = held_values(entries, times, signals, segments, max_slots)
    ranges = held.timed(held.timed(held.rows, "_slot", "from_ms"), "_until", "to_ms")
    return _unpack(ranges, "_row", "from_ms", "to_ms")


def boundary_values(entries: DataFrame, start_ms: int, end_ms: int, signals) -> DataFrame:
    """Per signal the last row before the window and the first one after it.

    ``side`` is ``before`` or ``after``; both come from one aggregation.
    """
    outside = (F.col("ts_ms") < start_ms) | (F.col("ts_ms") > end_ms)
    rows = restrict_to_signals(entries.filter(outside), signals)
    edges = rows.groupBy(*SIGNAL_KEY).agg(
        F.max_by(_row(), F.when(F.col("ts_ms") < start_ms, _when())).alias("before"),
        F.min_by(_row(), F.when(F.col("ts_ms") > end_ms, _when())).alias("after"),
    )
    sides = edges.select(
        *SIGNAL_KEY,
        F.explode(
            F.array(
                *[F.struct(F.lit(s).alias("side"), F.col(s).alias("row")) for s in ("before", "after")]
            )
        ).alias("_e"),
    ).filter(F.col("_e.row").isNotNull())
    return _unpack(
        sides.select(*SIGNAL_KEY, F.col("_e.side").alias("side"), F.col("_e.row").alias("_row")),
        "_row",
        "side",
    )


def _last_before(entries: DataFrame, start_ms: int, signals) -> DataFrame:
    rows = restrict_to_signals(entries.filter(F.col("ts_ms") < start_ms), signals)
    latest = rows.groupBy(*SIGNAL_KEY).agg(F.max_by(_row(), _when()).alias("_row"))
    return _unpack(latest, "_row")


def chunk_with_lead_in(entries: DataFrame, start_ms: int, end_ms: int, signals=None) -> DataFrame:
    """The window's rows and, per signal, the row that was in force at its start."""
    inside = restrict_to_signals(entries.filter(_in_window(start_ms, end_ms)), signals)
    lead_in = _last_before(entries, start_ms, signals)
    return (
        inside.select(*ENTRY_COLUMNS, F.lit(False).alias("lead_in"))
        .unionByName(lead_in.select(*ENTRY_COLUMNS, F.lit(True).alias("lead_in")))
    )


def state_intervals(
    entries: DataFrame, start_ms: int, end_ms: int, signals=None, segments: int | None = None
) -> DataFrame:
    """How long each value is held inside the window.

    The value in force at the window start opens there unless a row sits exactly
    on it; the last value of a signal runs to the window end.
    """
    rows = chunk_with_lead_in(entries, start_ms, end_ms, signals)
    held = following(rows, SIGNAL_KEY, TIME_ORDER, {"_next": F.col("ts_ms")}, segments)
    from_ms = F.greatest("ts_ms", F.lit(start_ms))
    to_ms = F.coalesce("_next", F.lit(end_ms).cast("long"))
    return (
        held.withColumns({"from_ms": from_ms, "to_ms": to_ms})
        .filter(~F.col("lead_in") | (F.col("to_ms") > F.col("from_ms")))
        .withColumn("held_ms", F.col("to_ms") - F.col("from_ms"))
        .select(
            *SIGNAL_KEY, "from_ms", "to_ms", "held_ms", "lead_in", "id", "source_id",
            "val_type", "val_bool", "val_int", "val_float", "val_str",
        )
    )


def boolean_edges(
    entries: DataFrame, start_ms: int, end_ms: int, signals=None, segments: int | None = None
) -> DataFrame:
    """Rows of the window where the boolean reading flips against the row before."""
    rows = restrict_to_signals(entries.filter(_in_window(start_ms, end_ms)), signals)
    high = F.coalesce(is_high(), F.lit(False))
    near = previous(rows.withColumn("high", high), SIGNAL_KEY, TIME_ORDER, {"_was": F.col("high")}, segments)
    return near.filter(F.col("_was") != F.col("high")).select(
        "id", "source_id", *SIGNAL_KEY, "ts_ms", "high"
    )


def signals_changed_in(entries: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return entries.filter(_in_window(start_ms, end_ms)).select(*SIGNAL_KEY).distinct()


def nearest_event(
    entries: DataFrame, probes: DataFrame, max_ms: float, segments: int | None = None
) -> DataFrame:
    """Per probe (``device_id, signal, t_ms``) the closest row time within ``max_ms``.

    The distance is strictly below the threshold; of two equally close rows the
    earlier one is taken; ``nearest_ms`` is NULL where no row is close enough.
    """
    asked = probes.select(*SIGNAL_KEY, F.col("t_ms").cast("long").alias("t_ms")).distinct()
    rows = restrict_to_signals(entries, asked).select(*SIGNAL_KEY, "ts_ms")
    merged = rows.select(*SIGNAL_KEY, F.col("ts_ms").alias("_t"), F.col("ts_ms").alias("_seen")).distinct().unionByName(
        asked.select(*SIGNAL_KEY, F.col("t_ms").alias("_t"), F.lit(None).cast("long").alias("_seen"))
    )
    # One row per signal and millisecond: a probe that coincides with a row merges with it.
    joint = merged.groupBy(*SIGNAL_KEY, "_t").agg(
        F.max("_seen").alias("_seen"), F.bool_or(F.col("_seen").isNull()).alias("_probe")
    )
    ordered = OrderedRows(joint, SIGNAL_KEY, ["_t"], segments)
    found = (
        ordered.known({"_before": F.col("_seen")}).known({"_after": F.col("_seen")}, backward=True).frame()
    )
    t = F.col("_t")
    to_before, to_after = t - F.col("_before"), F.col("_after") - t
    near_before = F.when(to_before < max_ms, to_before)
    near_after = F.when(to_after < max_ms, to_after)
    use_before = near_before.isNotNull() & (near_after.isNull() | (near_before <= near_after))
    return found.filter("_probe").select(
        *SIGNAL_KEY,
        t.alias("t_ms"),
        F.when(use_before, F.col("_before")).when(near_after.isNotNull(), F.col("_after")).alias("nearest_ms"),
    )


def _adjacent_marker(
    markers: DataFrame, probes: DataFrame, backward: bool, segments: int | None
) -> DataFrame:
    """Closest marker time strictly before (``backward``: after) every probe."""
    times = markers.select(F.col("time_ms").cast("long").alias("_m")).distinct()
    asked = probes.select(F.col("t_ms").cast("long").alias("t_ms")).distinct()
    probe = ProbeTimes(asked)
    if not probe.fits:
        shifted = asked.withColumn("_asked", F.col("t_ms")).withColumn(
            "t_ms", F.col("t_ms") + (1 if backward else -1)
        )
        found = asof_rows(times, shifted, [], ["_m"], {"marker_ms": F.col("_m")}, backward, segments)
        return found.select(F.col("_asked").alias("t_ms"), "marker_ms")
    if not probe.times:
        return asked.withColumn("marker_ms", F.lit(None).cast("long"))
    n = len(probe.times)
    if backward:
        # Number of probes strictly before the marker: it answers the last of them.
        slot = probe.count_up_to(F.col("_m") - 1) - 1
        best, order = F.min("_m"), F.col("_slot").desc()
    else:
        # Number of probes at or before the marker: it answers the first later one.
        slot = probe.count_up_to(F.col("_m"))
        best, order = F.max("_m"), F.col("_slot").asc()
    edges = times.groupBy(slot.alias("_slot")).agg(best.alias("_m")).filter(F.col("_slot").between(0, n - 1))
    grid = asked.withColumn("_slot", probe.count_up_to(F.col("t_ms")) - 1)
    joined = grid.join(edges, "_slot", "left")
    # One row per probe, at most MAX_SLOTS of them.
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select("t_ms", F.last("_m", ignorenulls=True).over(running).alias("marker_ms"))


def next_marker(markers: DataFrame, probes: DataFrame, segments: int | None = None) -> DataFrame:
    """First marker strictly after each ``t_ms``; NULL where there is none."""
    return _adjacent_marker(markers, probes, True, segments)


def prev_marker(markers: DataFrame, probes: DataFrame, segments: int | None = None) -> DataFrame:
    """Last marker strictly before each ``t_ms``; NULL where there is none."""
    return _adjacent_marker(markers, probes, False, segments)


def time_tree(entries: DataFrame, flt: EntryFilter | None = None) -> DataFrame:
    """Distinct seconds with data, split into date and clock parts, and their first row time."""
    rows = entries.filter(flt.predicate()) if flt else entries
    second = F.floor(F.col("ts_ms") / 1000)
    seconds = rows.groupBy(second.alias("_s")).agg(F.min("ts_ms").alias("ts_ms"))
    in_day = F.pmod("_s", F.lit(86400))
    return seconds.select(
        F.date_format(F.date_from_unix_date(F.floor(F.col("_s") / 86400).cast("int")), "yyyy-MM-dd").alias("date"),
        F.floor(in_day / 3600).cast("int").alias("hour"),
        F.floor(in_day % 3600 / 60).cast("int").alias("minute"),
        (in_day % 60).cast("int").alias("second"),
        "ts_ms",
    ).orderBy("date", "hour", "minute", "second")


def time_range(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.min("ts_ms").alias("start_ms"),
        F.max("ts_ms").alias("end_ms"),
        (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"),
    )

"""Merging several sources and dropping repeated reports of the same value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.functions.values import value_struct
from sigtrail.plans.ordered import OrderedRows
from sigtrail.schema import ENTRY_COLUMNS, SIGNAL_KEY, TIME_ORDER
from sigtrail.session import cut_lineage

DEFAULT_WINDOW_MS = 1000
# Distinct milliseconds one task thins out at a time.
_BLOCK_MS = 1 << 22
# Blocks whose summaries one task joins.
_FANOUT = 64
# Runs with up to this many late times are handled as one array.
_SHORT_RUN = 1_000
# A run is named by the position of its first row.
_RUN = ["run_ms", "run_source", "run_id"]
_RUN_SCHEMA = "run_ms long, run_source string, run_id long"


def merge_logs(frames: Sequence[DataFrame], source_ids: Sequence[str]) -> DataFrame:
    """Rows of all sources, each tagged with its source; sort by ``TIME_ORDER`` to read."""
    tagged = [
        f.select(*[F.lit(s).alias(c) if c == "source_id" else F.col(c) for c in ENTRY_COLUMNS])
        for f, s in zip(frames, source_ids)
    ]
    return reduce(DataFrame.unionByName, tagged)


def _jumps(times: np.ndarray, window_ms: int) -> np.ndarray:
    """Index of the first time at least ``window_ms`` after each time."""
    return np.searchsorted(times, times + window_ms, side="left")


def _block_exits(window_ms: int):
    """A block as a map: for every time that may be the first one kept in it, the
    last one kept.  Only the first ``window_ms`` and the time after can be first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["ts_ms"].to_numpy())
        jump = _jumps(times, window_ms)
        entries = np.arange(min(jump[0] + 1, len(times)))
        at = entries.copy()
        while True:
            step = jump[at]
            inside = step < len(times)
            if not inside.any():
                break
            at = np.where(inside, step, at)
        keys = {c: pdf[c].iloc[0] for c in (*_RUN, "block")}
        return pd.DataFrame({**keys, "enter_ms": times[entries], "exit_ms": times[at]})

    return run


def _group_exits(window_ms: int):
    """The map of neighbouring blocks together, from their own maps.

    An entry later than ``window_ms`` after the first can't be the first one kept, but
    for the next one, so the map is no longer than that of a block.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        enters, exits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, part in pdf.sort_values(["block", "enter_ms"]).groupby("block", sort=True):
            enter, leave = part["enter_ms"].to_numpy(), part["exit_ms"].to_numpy()
            at = np.searchsorted(enter, exits + window_ms, side="left")
            inside = at < len(enter)
            exits = np.where(inside, leave[np.minimum(at, len(enter) - 1)], exits)
            if not len(enters) or enters[-1] < enters[0] + window_ms:
                bound = (enters[0] if len(enters) else enter[0]) + window_ms
                more = min(int(np.searchsorted(enter, bound, side="left")) + 1, len(enter))
                enters, exits = np.append(enters, enter[:more]), np.append(exits, leave[:more])
        keys = {c: pdf[c].iloc[0] for c in (*_RUN, "above")}
        return pd.DataFrame({**keys, "enter_ms": enters, "exit_ms": exits}).rename(columns={"above": "block"})

    return run


def _group_entries(window_ms: int):
    """Chain the maps of a group of blocks: the first time kept in each of them.

    ``due_ms`` is the first time kept in the group; without it, its first time is.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "enter_ms"])
        due, found = pdf["due_ms"].iloc[0], []
        for block, part in pdf.groupby("block", sort=True):
            enter = part["enter_ms"].to_numpy()
            at = 0 if pd.isna(due) else int(np.searchsorted(enter, due, side="left"))
            if at < len(enter):
                found.append((block, enter[at]))
                due = part["exit_ms"].to_numpy()[at] + window_ms
        keys = {c: pdf[c].iloc[0] for c in _RUN}
        blocks = pd.DataFrame(found, columns=["block", "first_ms"])
        return blocks.assign(**keys)[[*_RUN, "block", "first_ms"]]

    return run


def _kept_times(window_ms: int):
    """The times kept in a block, from its first kept one on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["ts_ms"].to_numpy())
        jump = _jumps(times, window_ms)
        at = int(np.searchsorted(times, pdf["first_ms"].iloc[0], side="left"))
        kept = []
        while at < len(times):
            kept.append(times[at])
            at = jump[at]
        keys = {c: pdf[c].iloc[0] for c in _RUN}
        return pd.DataFrame({**keys, "ts_ms": np.array(kept, dtype=np.int64)})

    return run


def _thin_out(times: DataFrame, window_ms: int) -> DataFrame:
    """Times of a run that are kept when each must be ``window_ms`` after the one
    kept before it, the first being kept.

    The rule is sequential, so a run is cut into blocks of bounded size, which are
    summarised in parallel.  The summaries are joined in a tree of ``_FANOUT`` branches,
    up to one for each run and down again to each block, so no task chains a whole run;
    then the blocks are finished in parallel.
    """
    keys = f"{_RUN_SCHEMA}, block long"
    above = F.floor(F.col("block") / _FANOUT).alias("above")
    maps = f"{keys}, enter_ms long, exit_ms long"
    levels = [cut_lineage(times.groupBy(*_RUN, "block").applyInPandas(_block_exits(window_ms), maps))]
    while levels[-1].agg(F.max("block")).first()[0] >= _FANOUT:
        groups = levels[-1].select("*", above).groupBy(*_RUN, "above")
        levels.append(cut_lineage(groups.applyInPandas(_group_exits(window_ms), maps)))
    firsts = levels[-1].select(*_RUN, F.lit(0).cast("long").alias("block"), F.lit(None).cast("long").alias("first_ms")).distinct()
    for level in reversed(levels):
        due = firsts.select(*_RUN, F.col("block").alias("above"), F.col("first_ms").alias("due_ms"))
        groups = level.select("*", above).join(due, [*_RUN, "above"]).groupBy(*_RUN, "above")
        firsts = cut_lineage(groups.applyInPandas(_group_entries(window_ms), f"{keys}, first_ms long"))
    started = times.join(firsts, [*_RUN, "block"])
    return started.groupBy(*_RUN, "block").applyInPandas(
        _kept_times(window_ms), f"{_RUN_SCHEMA}, ts_ms long"
    )


def _kept_in_order(times: Column, window_ms: int) -> Column:
    """The same rule over one short, sorted array."""
    none = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(state, t):
        keep = state["last"].isNull() | (t - state["last"] >= window_ms)
        return F.when(
            keep, F.struct(t.alias("last"), F.concat(state["kept"], F.array(t)).alias("kept"))
        ).otherwise(state)

    return F.aggregate(times, none, step, lambda state: state["kept"])


def _kept_late(times: DataFrame, window_ms: int) -> DataFrame:
    """Kept times of all runs: short runs as arrays, long ones block by block."""
    sizes = times.groupBy(*_RUN).agg(F.count(F.lit(1)).alias("n"))
    sized = times.join(sizes, _RUN)
    short = (
        sized.filter(F.col("n") <= _SHORT_RUN)
        .groupBy(*_RUN)
        .agg(F.sort_array(F.collect_list("ts_ms")).alias("t"))
        .select(*_RUN, F.explode(_kept_in_order(F.col("t"), window_ms)).alias("ts_ms"))
    )
    if sizes.filter(F.col("n") > _SHORT_RUN).isEmpty():
        return short
    return short.unionByName(_thin_out(sized.filter(F.col("n") > _SHORT_RUN).drop("n"), window_ms))


def dedupe(
    entries: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    scope: str = "adjacent",
    segments: int | None = None,
) -> DataFrame:
    """Drop a row that repeats the last kept row's signal and value within ``window_ms``.

    ``adjacent`` compares with the last kept row of the whole log, so a row of any
    other signal in between ends the repetition; ``per_signal`` compares inside each
    signal.  A log of a single source is returned as it is.
    """
    if scope not in ("adjacent", "per_signal"):
        raise ValueError(f"unknown scope: {scope}")
    if window_ms <= 0 or entries.select("source_id").distinct().limit(2).count() < 2:
        return entries
    keys = SIGNAL_KEY if scope == "per_signal" else []
    same = F.struct(*SIGNAL_KEY, value_struct().alias("value"))
    rows = OrderedRows(entries, keys, TIME_ORDER, segments).neighbour(
        {"_same": same, "_before_ms": F.col("ts_ms")}
    )
    # A run is a stretch of repetitions without a gap of window_ms; its head is kept.
    head = ~F.col("_same").eqNullSafe(same) | (F.col("ts_ms") - F.col("_before_ms") >= window_ms)
    at_head = lambda c: F.when(F.col("_head"), F.col(c))
    runs = (
        rows.with_column("_head", head)
        .settle()
        .known({n: at_head(c) for n, c in zip(_RUN, TIME_ORDER)})
        .frame()
    )
    # Rows inside the window after the head repeat it; of rows at one time the first counts.
    # Only these are written: three branches read them, and they are few.
    late = F.col("ts_ms") - F.col("run_ms") >= window_ms
    first_at_time = F.col("_before_ms") < F.col("ts_ms")
    candidates = cut_lineage(runs.filter(~F.col("_head") & late & first_at_time).select(*ENTRY_COLUMNS, *_RUN))
    heads = runs.filter("_head").select(*ENTRY_COLUMNS)
    if candidates.isEmpty():
        return heads
    block = F.floor((F.col("ts_ms") - F.col("run_ms")) / _BLOCK_MS).alias("block")
    times = candidates.select(*_RUN, "ts_ms", block)
    kept = candidates.join(_kept_late(times, window_ms), [*_RUN, "ts_ms"], "left_semi")
    return heads.unionByName(kept.select(*ENTRY_COLUMNS))

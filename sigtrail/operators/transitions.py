"""Transition (tact-time) analysis: pairing events by rule, statistics, trend, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.functions.values import is_empty, value_number, value_text
from sigtrail.plans.ordered import OrderedRows, position
from sigtrail.plans.percentiles import exact_percentiles
from sigtrail.plans.stages import bind
from sigtrail.schema import BOOL, SIGNAL_KEY, STRING, TIME_ORDER, VALUE_COLUMNS
from sigtrail.session import cut_lineage, is_small

CYCLE, A_TO_B, POPULATED = "cycle", "a-to-b", "value-populated"
TRANSITION_COLUMNS = ["rule_id", "start_ms", "end_ms", "duration_ms", "status"]


def condition_matches(
    condition: Column,
    value: Column,
    coerce_numeric: bool = False,
    text: Column | None = None,
    number: Column | None = None,
    empty: Column | None = None,
) -> Column:
    """The entry's tagged value satisfies ``condition`` against the text ``value``.

    Equality is typed: numbers compare as numbers, everything else as text.
    ``greater`` and ``less`` read strings as 0 unless ``coerce_numeric``.  ``text``,
    ``number`` and ``empty`` are the value's readings where they are at hand as columns.
    """
    wanted = value.try_cast("double")
    # A boolean rule value counts as 1/0, other text as 0.
    threshold = F.coalesce(wanted, F.when(F.lower(value) == "true", F.lit(1.0)), F.lit(0.0))
    number = value_number(coerce_numeric) if number is None else number
    same_text = (value_text() if text is None else text).eqNullSafe(value)
    equal = F.when(F.col("val_type").isin(BOOL, STRING), same_text).otherwise(
        same_text | F.coalesce(number == wanted, F.lit(False))
    )
    return (
        F.when(condition == "equals", equal)
        .when(condition == "not-equals", ~equal)
        .when(condition == "greater", number > threshold)
        .when(condition == "less", number < threshold)
        .when(condition == "not-empty", ~(is_empty() if empty is None else empty))
        .otherwise(False)
    )


def transition_status(duration: Column, target: Column, tolerance: Column) -> Column:
    slack = F.coalesce(tolerance, F.lit(0.0))
    return (
        F.when(target.isNull(), F.lit("no-target"))
        .when(duration > target + slack, F.lit("above"))
        .when(duration < target - slack, F.lit("below"))
        .otherwise(F.lit("ok"))
    )


def _rule_rows(entries: DataFrame, rules: DataFrame, coerce_numeric: bool) -> DataFrame:
    """Rows of the signals the rules name, once per rule, with start/end matches."""
    start = rules.select("*", F.col("start_device").alias("device_id"), F.col("start_signal").alias("signal"))
    end = rules.filter(
        (F.col("type") == A_TO_B)
        & ~(
            F.col("end_device").eqNullSafe(F.col("start_device"))
            & F.col("end_signal").eqNullSafe(F.col("start_signal"))
        )
        & F.col("end_device").isNotNull()
    ).select("*", F.col("end_device").alias("device_id"), F.col("end_signal").alias("signal"))
    watched = start.unionByName(end)
    read = bind(
        entries.select(*SIGNAL_KEY, *TIME_ORDER, *VALUE_COLUMNS),
        _text=value_text(),
        _number=value_number(coerce_numeric),
        _empty=is_empty(),
    ).drop("val_bool", "val_int", "val_float", "val_str")
    joined = read.join(F.broadcast(watched) if is_small(rules) else watched, SIGNAL_KEY)
    on_start = (F.col("device_id") == F.col("start_device")) & (F.col("signal") == F.col("start_signal"))
    on_end = (F.col("device_id") == F.col("end_device")) & (F.col("signal") == F.col("end_signal"))
    holds = lambda side: condition_matches(
        F.col(f"{side}_cond"), F.col(f"{side}_value"), text=F.col("_text"), number=F.col("_number"), empty=F.col("_empty")
    )
    populated = F.col("type") == POPULATED
    starts = F.when(populated, F.col("_empty")).otherwise(holds("start"))
    ends = (
        F.when(populated, on_start & ~F.col("_empty"))
        .when(F.col("type") == A_TO_B, on_end & holds("end"))
        .otherwise(False)
    )
    matched = bind(
        joined,
        s=F.coalesce(on_start & starts, F.lit(False)),
        e=F.coalesce(ends, F.lit(False)),
    )
    return matched.filter(F.col("s") | F.col("e")).select(
        "rule_id", "type", *TIME_ORDER, "s", "e", "target_ms", "tolerance_ms"
    )


def _switches(rows: DataFrame, entries: DataFrame, segments: int | None) -> OrderedRows:
    """Rows that arm a rule or end a transition (``fires``).

    A paired rule is idle or armed.  A start-only row leaves it armed, an end-only
    row leaves it idle and a row that is both flips it.  So the state after a row
    is the state set by the last one-sided row, flipped once per two-sided row
    since: a running count and a "last known" column instead of a loop.  Every
    match of a cycle rule both ends a transition and starts the next.
    """
    both = (F.col("s") & F.col("e")).cast("long")
    setting = F.when(
        F.col("s") != F.col("e"), F.struct(F.col("s").alias("armed"), F.col("flips").alias("at"))
    )
    ordered = (
        OrderedRows(rows, ["rule_id"], TIME_ORDER, segments, within=entries)
        .settle()
        .running_total({"flips": both})
        .known({"set": setting})
    )
    armed = F.coalesce(F.col("set.armed"), F.lit(False))
    odd = (F.col("flips") - F.coalesce(F.col("set.at"), F.lit(0))) % 2 == 1
    states = ordered.with_column("after", armed != odd).settle().neighbour({"before": F.col("after")})
    is_cycle = F.col("type") == CYCLE
    switched = F.coalesce("before", F.lit(False)) != F.col("after")
    return states.filter(is_cycle | switched).with_column("fires", is_cycle | ~F.col("after"))


def transitions(
    entries: DataFrame, rules: DataFrame, coerce_numeric: bool = False, segments: int | None = None
) -> DataFrame:
    """Transitions of all rules in one job.

    cycle: from each start match to the next.  a-to-b: from the first start match
    while idle to the next end match; a row that ends a transition cannot start the
    next one.  value-populated: from the first empty value to the next filled one.
    """
    events = _switches(_rule_rows(entries, rules, coerce_numeric), entries, segments)
    # Arming and firing rows alternate, so a transition starts at the row before its end.
    near = events.neighbour({"start_ms": F.col("ts_ms")})
    duration = F.col("ts_ms") - F.col("start_ms")
    return (
        near.frame()
        .filter(F.col("fires") & F.col("start_ms").isNotNull())
        .select(
            "rule_id",
            "start_ms",
            F.col("ts_ms").alias("end_ms"),
            duration.alias("duration_ms"),
            transition_status(duration, F.col("target_ms"), F.col("tolerance_ms")).alias("status"),
        )
    )


def cycle_transitions(entries: DataFrame, rules: DataFrame, **options) -> DataFrame:
    return transitions(entries, rules.filter(F.col("type") == CYCLE), **options)


def ab_transitions(entries: DataFrame, rules: DataFrame, **options) -> DataFrame:
    return transitions(entries, rules.filter(F.col("type") == A_TO_B), **options)


def populated_transitions(entries: DataFrame, rules: DataFrame, **options) -> DataFrame:
    return transitions(entries, rules.filter(F.col("type") == POPULATED), **options)


def transition_stats(found: DataFrame, rules: DataFrame) -> DataFrame:
    """One row of statistics per rule; a rule without transitions has zeros.

    Everything derives from one row per rule and distinct duration, which is
    written once because the percentiles read it more than once.
    """
    d, n = F.col("duration_ms"), F.col("n")
    counted = cut_lineage(
        found.groupBy("rule_id", "duration_ms", "status").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("start_ms").alias("first_start_ms"),
            F.max("end_ms").alias("last_end_ms"),
        )
    )
    tally = lambda s: F.sum(F.when(F.col("status") == s, n).otherwise(0))
    basic = counted.groupBy("rule_id").agg(
        F.sum("n").alias("count"),
        F.min(d).alias("min_ms"),
        F.max(d).alias("max_ms"),
        F.sum(d * n).alias("total_ms"),
        (F.sum(d * n) / F.sum(n)).alias("mean_ms"),
        F.min("first_start_ms").alias("first_start_ms"),
        F.max("last_end_ms").alias("last_end_ms"),
        tally("ok").alias("within"),
        tally("above").alias("above"),
        tally("below").alias("below"),
    )
    spread = (
        counted.select("rule_id", d, n)
        .join(basic.select("rule_id", "mean_ms"), "rule_id")
        .groupBy("rule_id")
        .agg(F.sqrt(F.sum(n * F.pow(d - F.col("mean_ms"), F.lit(2.0))) / F.sum(n)).alias("stddev_ms"))
    )
    ranks = exact_percentiles(
        counted, ["rule_id"], "duration_ms", {"median_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95}, "n"
    )
    slack = F.coalesce("tolerance_ms", F.lit(0.0))
    bounds = rules.select(
        "rule_id", (F.col("target_ms") - slack).alias("target_lower"), (F.col("target_ms") + slack).alias("target_upper")
    )
    joined = bounds.join(basic.join(spread, "rule_id").join(ranks, "rule_id"), "rule_id", "left")
    zero = ["count", "min_ms", "max_ms", "total_ms", "mean_ms", "median_ms", "p90_ms", "p95_ms", "stddev_ms", "within", "above", "below"]
    filled = joined.fillna(0, subset=zero)
    elapsed = F.coalesce(F.greatest(F.lit(0), F.col("last_end_ms") - F.col("first_start_ms")), F.lit(0))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    count = F.col("count")
    return filled.select(
        "rule_id", "count", "min_ms", "max_ms", "mean_ms", "median_ms", "p90_ms", "p95_ms", "stddev_ms",
        (F.col("max_ms") - F.col("min_ms")).alias("range_ms"),
        ratio(F.col("stddev_ms"), F.col("mean_ms")).alias("cv"),
        "total_ms", "first_start_ms", "last_end_ms",
        elapsed.alias("elapsed_ms"),
        ratio(count * 3_600_000, elapsed).alias("throughput_per_hour"),
        "target_lower", "target_upper", "within", "above", "below",
        ratio(F.col("within") * 100, count).alias("within_pct"),
        ratio(F.col("above") * 100, count).alias("above_pct"),
        ratio(F.col("below") * 100, count).alias("below_pct"),
    )


def trend(
    found: DataFrame,
    mode: str = "none",
    window: int = 10,
    bucket_minutes: float = 5,
    segments: int | None = None,
) -> DataFrame:
    """Durations over time: as they are, as a moving average or per time bucket."""
    if mode == "moving":
        return _moving_average(found, window, segments)
    if mode == "bucket":
        width = int(bucket_minutes * 60_000)
        start = F.floor(F.col("start_ms") / width) * width
        return (
            found.groupBy("rule_id", start.cast("long").alias("time_ms"))
            .agg(F.avg("duration_ms").alias("value"), F.count(F.lit(1)).alias("count"))
            .orderBy("rule_id", "time_ms")
        )
    return found.select("rule_id", F.col("start_ms").alias("time_ms"), F.col("duration_ms").alias("value"))


_BLOCK_ROWS = 1_000_000


def _moving_average(found: DataFrame, window: int, segments: int | None) -> DataFrame:
    """Mean of the last ``window`` durations of the rule (fewer at its start).

    Rows are numbered per rule and cut into blocks of a fixed number of rows;
    each block also gets the last ``window - 1`` rows of the block before it.
    """
    size = max(_BLOCK_ROWS, window)
    numbered = position(cut_lineage(found), ["rule_id"], ["start_ms", "end_ms"], "_pos", segments)
    block = F.floor(F.col("_pos") / size)
    tail = (F.col("_pos") % size) >= size - (window - 1)
    homes = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("_home", block).withColumn("_block", F.explode(homes))
    frame = (
        Window.partitionBy("rule_id", "_block").orderBy("_pos").rowsBetween(-(window - 1), 0)
    )
    return (
        spread.withColumns(
            {"value": F.avg("duration_ms").over(frame), "count": F.count(F.lit(1)).over(frame)}
        )
        .filter(F.col("_home") == F.col("_block"))
        .select("rule_id", F.col("start_ms").alias("time_ms"), "value", "count")
    )


def duration_histogram(found: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Histogram of durations per rule with a bin count that follows the number of rows.

    Empty bins are kept.  With ``rules`` the bin holding the target is flagged.
    """
    counted = cut_lineage(
        found.groupBy("rule_id", "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    )
    size = F.sum("n")
    low, high = F.min("duration_ms"), F.max("duration_ms")
    # ceil(1 + 3.322 * log10(n)) bins, at least five.
    bins = F.greatest(F.lit(5), F.ceil(1 + F.lit(3.322) * F.log10(size)).cast("int"))
    shape = counted.groupBy("rule_id").agg(
        low.alias("low"),
        bins.alias("bins"),
        F.coalesce(F.nullif((high - low) / bins, F.lit(0.0)), F.lit(1.0)).alias("width"),
    )
    at = F.floor((F.col("duration_ms") - F.col("low")) / F.col("width")).cast("int")
    filled = (
        counted.join(shape, "rule_id")
        .groupBy("rule_id", F.least(at, F.col("bins") - 1).alias("bin"))
        .agg(F.sum("n").alias("count"))
    )
    axis = shape.select("rule_id", "low", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    out = axis.join(filled, ["rule_id", "bin"], "left").select(
        "rule_id",
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
    if rules is None:
        return out
    target = rules.select("rule_id", F.nullif("target_ms", F.lit(0.0)).alias("_target"))
    holds = F.col("_target").between(F.col("bin_start"), F.col("bin_end"))
    return out.join(target, "rule_id", "left").select(
        *out.columns, F.coalesce(holds, F.lit(False)).alias("has_target")
    )

"""Units on a layout: device mapping, rule-driven status, carriers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.functions.values import script_number, value_text
from sigtrail.operators.asof import HeldValues, held_values, values_at
from sigtrail.plans.ordered import OrderedRows, position
from sigtrail.plans.stages import bind
from sigtrail.schema import BOOL, VALUE_COLUMNS
from sigtrail.session import cut_lineage, is_small

DEFAULT_COLOR = "#D3D3D3"
CARRIER_SIGNAL = "CurrentLocation"
_LABEL_CHARS = 6
# Wildcard patterns that may ride along as one array.
_INLINE_PATTERNS = 2_000
# Up to so many probes it is cheaper to look at each than to work out ranges.
_FEW_PROBES = 64
# Up to so many rules it is cheaper to try each than to arrange them for a search.
_FEW_RULES = 64


def fallback_unit(device: Column) -> Column:
    """Text after the last dot, cut at ``@``."""
    return F.substring_index(F.substring_index(device, ".", -1), "@", 1)


def _like(pattern: Column) -> Column:
    """A ``*`` wildcard as a LIKE pattern; every other character is literal."""
    escaped = F.regexp_replace(pattern, r"([\\%_])", r"\\$1")
    return F.translate(escaped, "*", "%")


_GRAM = 3
_SALTS = 64


def _candidates(names: DataFrame, rest: DataFrame) -> DataFrame:
    """Devices with the wildcard patterns that they may match.

    A pattern is found by the text before its first wildcard or after its last one,
    whichever is longer; one with neither by a piece of the text inside it.
    """
    head, tail = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    front = F.length(head) >= F.length(tail)
    split = rest.withColumn("_front", front).withColumn("_end", F.when(front, head).otherwise(tail))
    keyed = split.filter("_end <> ''")
    lengths = keyed.select("_front", F.length("_end").alias("_size")).distinct()
    sizes = lengths.groupBy("_front").agg(F.collect_set("_size").alias("_sizes"))  # lengths of names
    ends = names.crossJoin(F.broadcast(sizes)).withColumn("_size", F.explode("_sizes"))  # two rows at most
    ends = ends.filter(F.length("device_id") >= F.col("_size"))
    end = F.when(F.col("_front"), F.expr("left(device_id, _size)")).otherwise(F.expr("right(device_id, _size)"))
    anchored = ends.select("device_id", "_front", end.alias("_end")).join(keyed, ["_front", "_end"]).drop("_front", "_end")
    inside = split.filter("_end = ''").drop("_front", "_end")
    return anchored.unionByName(_infix_candidates(names, inside)) if inside.limit(1).count() else anchored


def _grams(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - _GRAM + 1), lambda i: F.substring(text, i, F.lit(_GRAM)))


def _infix_candidates(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Devices with the patterns of which they have the rarest gram.

    Grams are those of a pattern's longest literal piece; a gram's rarity is counted over
    the devices.  Patterns of shorter pieces are few different ones; they meet all
    devices, but dealt over salts.
    """
    piece = F.expr("array_max(transform(split(pattern, '[*]'), x -> struct(length(x) AS n, x)))")
    cut = patterns.withColumn("_piece", piece["x"])
    long = cut.filter(F.length("_piece") >= _GRAM).withColumn("_gram", F.explode(_grams(F.col("_piece"))))
    wanted = long.select("_gram").distinct()
    own = names.filter(F.length("device_id") >= _GRAM).select("device_id", F.explode(F.array_distinct(_grams(F.col("device_id")))).alias("_gram"))
    met = own.join(wanted, "_gram", "left_semi")
    counted = long.join(met.groupBy("_gram").count(), "_gram", "left")
    rare = F.min_by("_gram", F.struct(F.coalesce("count", F.lit(0)), "_gram"))
    chosen = counted.groupBy("pattern", "like", "ord", "unit_id").agg(rare.alias("_gram"))
    by_gram = met.join(chosen, "_gram").drop("_gram")
    short = cut.filter(F.length("_piece") < _GRAM).drop("_piece").withColumn("_salt", F.pmod(F.hash("pattern"), F.lit(_SALTS)))
    everywhere = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return by_gram.unionByName(everywhere.join(short, "_salt").drop("_salt").select(*by_gram.columns))


def map_devices(devices: DataFrame, mapping: DataFrame) -> DataFrame:
    """``device_id, unit_id`` by the first matching mapping row (``ord``), else by the name.

    Patterns are exact or hold ``*`` wildcards.  Only distinct devices are matched.
    """
    names = devices.select("device_id").distinct()
    wild = F.contains("pattern", F.lit("*"))
    choice = F.struct(F.col("ord").cast("long").alias("ord"), "unit_id")
    exact = (
        mapping.filter(~wild)
        .groupBy(F.col("pattern").alias("device_id"))
        .agg(F.min(choice).alias("_exact"))
    )
    rest = mapping.filter(wild).select("pattern", _like(F.col("pattern")).alias("like"), F.col("ord").cast("long").alias("ord"), "unit_id")
    matched = names.join(exact, "device_id", "left")
    listed = [r.asDict() for r in rest.drop("pattern").limit(_INLINE_PATTERNS + 1).collect()]
    if len(listed) <= _INLINE_PATTERNS:
        patterns = F.from_json(F.lit(json.dumps(listed)), "array<struct<ord: bigint, unit_id: string, like: string>>")
        hits = F.filter(patterns, lambda p: F.like("device_id", p["like"]))
        found = F.array_min(F.transform(hits, lambda p: F.struct(p["ord"], p["unit_id"])))
        matched = matched.withColumn("_wild", found)
    else:
        # A pattern that is listed several times counts once.
        once = rest.groupBy("pattern", "like").agg(F.min(F.struct("ord", "unit_id")).alias("_first")).select("pattern", "like", "_first.*")
        by_device = (
            _candidates(names, once)
            .filter("device_id LIKE like")
            .groupBy("device_id")
            .agg(F.min(choice).alias("_wild"))
        )
        matched = matched.join(by_device, "device_id", "left")
    best = F.least("_exact", "_wild")
    return matched.select(
        "device_id",
        F.when(best.isNotNull(), best["unit_id"]).otherwise(fallback_unit(F.col("device_id"))).alias("unit_id"),
    )


def _plain(text: Column) -> Column:
    lowered = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(lowered.isin("on", "true", "1"), F.lit("true"))
        .when(lowered.isin("off", "false", "0"), F.lit("false"))
        .otherwise(lowered)
    )


def rule_matches(value: Column, op: Column, rule_value: Column, number: Column | None = None) -> Column:
    """A colour rule holds for a value given as text.

    Equality treats on/true/1 and off/false/0 alike and ignores case; the order
    comparisons are numeric and false for text.  ``number`` overrides the numeric
    reading of the value.
    """
    left = script_number(value) if number is None else number
    right = script_number(rule_value)
    compared = (
        F.when(op == ">", left > right)
        .when(op == ">=", left >= right)
        .when(op == "<", left < right)
        .when(op == "<=", left <= right)
    )
    return (
        F.when(op == "==", _plain(value) == _plain(rule_value))
        .when(op == "!=", _plain(value) != _plain(rule_value))
        .otherwise(F.coalesce(compared, F.lit(False)))
    )


def rule_index(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules of each signal, arranged so that a value finds the best one that holds
    without meeting the others.

    First frame, by signal: thresholds in order, each with the best rule up to it
    (``above`` for ``>`` and ``>=``, ``below`` for the others, negated), and the best two
    ``!=`` rules that exclude different values.  Second frame, by signal and value: the
    best ``==`` rule.  A best rule is ``p, ord`` and what it shows, smallest first.
    """
    best = F.struct((-F.col("priority")).alias("p"), "ord", _shown().alias("shown"))
    ranked = rules.select("signal", "op", _plain(F.col("value")).alias("plain"), script_number(F.col("value")).alias("number"), best.alias("best"))

    def thresholds(weak: str, strict: str, sign: int, name: str) -> DataFrame:
        own = ranked.filter(F.col("op").isin(weak, strict) & F.col("number").isNotNull())
        placed = own.select("signal", (F.col("number") * sign).alias("t"), (F.col("op") == strict).cast("int").alias("strict"), "best")
        upto = Window.partitionBy("signal").orderBy("t", "strict").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return placed.withColumn("best", F.min("best").over(upto)).groupBy("signal").agg(F.array_sort(F.collect_list(F.struct("t", "strict", "best"))).alias(name))

    unlike = ranked.filter("op = '!='").groupBy("signal", "plain").agg(F.min("best").alias("best"))
    place = F.row_number().over(Window.partitionBy("signal").orderBy("best"))
    unlike = unlike.withColumn("place", place).filter("place <= 2").groupBy("signal").agg(F.array_sort(F.collect_list(F.struct("best", "plain"))).alias("unlike"))
    ordered = thresholds(">=", ">", 1, "above").join(thresholds("<=", "<", -1, "below"), "signal", "full")
    equal = ranked.filter("op = '=='").groupBy("signal", "plain").agg(F.min("best").alias("equal"))
    return ordered.join(unlike, "signal", "full"), equal


def _best_upto(table: Column, number: Column, bits: int) -> Column:
    """Best rule of the last threshold that ``number`` reaches (binary search)."""
    reached = F.struct(number.alias("t"), F.lit(0).alias("strict"))

    def step(at: Column, size: Column) -> Column:
        there = F.get(table, at + size - 1)
        inside = (at + size <= F.size(table)) & (F.struct(there["t"].alias("t"), there["strict"].alias("strict")) <= reached)
        return F.when(F.coalesce(inside, F.lit(False)), at + size).otherwise(at)

    at = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(bits))]), F.lit(0), step)
    return F.when(number.isNotNull() & table.isNotNull(), F.get(table, at - 1)["best"])


def _hits(per_unit: DataFrame, rules: DataFrame, *keep: str) -> DataFrame:
    """The best rule of its signal that holds for each value (``unit_id, signal``, the
    value and ``keep``), with its rank and what it shows; values without one are left out.
    Of few rules all that hold are given."""
    valued = bind(
        per_unit,
        _text=value_text(),
        _flag=F.when(F.col("val_type") == BOOL, F.col("val_bool").cast("double")),
    )
    valued = bind(valued, _number=F.coalesce("_flag", script_number(F.col("_text"))), plain=_plain(F.col("_text")))
    number = rules.count()
    if number <= _FEW_RULES:
        return _tried(valued, rules, *keep)
    few = is_small(rules)
    # A table of not too many rules is arranged in one task and sent to all.
    index, equal = (F.broadcast(df) if few else df for df in rule_index(rules.coalesce(1) if few else rules))
    bits = number.bit_length()
    met = valued.join(index, "signal", "left").join(equal, ["signal", "plain"], "left")
    other = F.filter("unlike", lambda rule: rule["plain"] != F.col("plain"))
    ways = [F.col("equal"), F.get(other, F.lit(0))["best"], _best_upto(F.col("above"), F.col("_number"), bits), _best_upto(F.col("below"), -F.col("_number"), bits)]
    best = bind(met, _best=F.array_min(F.array_compact(F.array(*ways)))).filter("_best IS NOT NULL")
    return best.select("unit_id", *keep, F.struct("_best.p", "_best.ord").alias("_rank"), F.col("_best.shown").alias("_s"))


def _tried(valued: DataFrame, rules: DataFrame, *keep: str) -> DataFrame:
    """All rules of a value's signal that hold, by trying each."""
    named = rules.select("signal", "op", F.col("value").alias("rule_value"), "priority", "ord", _shown().alias("_s"))
    hits = valued.join(named, "signal").filter(rule_matches(F.col("_text"), F.col("op"), F.col("rule_value"), F.col("_number")))
    return hits.select("unit_id", *keep, F.struct((-F.col("priority")).alias("p"), "ord").alias("_rank"), "_s")


def _shown() -> Column:
    """What a rule shows."""
    return F.struct(F.coalesce(F.nullif("color", F.lit("")), F.col("bg_color")).alias("color"), F.col("text").alias("text"))


def _status(values: DataFrame, rules: DataFrame, mapped: DataFrame, *at: str) -> DataFrame:
    """Best matching rule per unit (and probe time ``at``); ``mapped`` names each
    device's unit."""
    # Of several devices on a unit the greatest id supplies the signal.
    picked = values.join(mapped, "device_id").groupBy(*at, "unit_id", "signal").agg(
        F.max_by(F.struct(*VALUE_COLUMNS), "device_id").alias("_v")
    )
    hits = _hits(picked.select(*at, "unit_id", "signal", "_v.*"), rules, *at)
    return hits.groupBy(*at, "unit_id").agg(F.min_by("_s", "_rank").alias("_s"))


def _status_ranges(held: HeldValues, rules: DataFrame, mapped: DataFrame, segments: int | None, whole: bool = True) -> DataFrame:
    """``unit_id, _slot, _until, _s``: runs of probes at which a rule shows the same.

    Rules are tested once for each value held.  A unit's status can only change where
    the range of a rule that holds begins or ends, so its ranges are cut at these places
    and compared there; if they are to be ``whole``, equal neighbours become one.
    """
    on_unit = held.rows.select("device_id", "signal", "_row.*", "_slot", "_until").join(mapped, "device_id")
    # A device supplies the signal until one with a greater id has a value.
    greater = Window.partitionBy("unit_id", "signal").orderBy(F.desc("device_id")).rowsBetween(Window.unboundedPreceding, -1)
    begins = on_unit.groupBy("unit_id", "signal", "device_id").agg(F.min("_slot").alias("_begin"))
    turns = begins.select("unit_id", "signal", "device_id", F.min("_begin").over(greater).alias("_end"))
    supplied = on_unit.join(turns, ["unit_id", "signal", "device_id"]).withColumn("_until", F.least("_until", F.col("_end") - 1))
    picked = supplied.filter("_slot <= _until").select("unit_id", "signal", *VALUE_COLUMNS, "_slot", "_until")
    hits = cut_lineage(_hits(picked, rules, "_slot", "_until"))
    edges = hits.select("unit_id", F.explode(F.array(F.col("_slot"), F.col("_until") + 1)).alias("_edge")).distinct()
    numbered = position(edges, ["unit_id"], ["_edge"], "_n", segments)
    placed = hits
    for slot, name in (("_slot", "_first"), ("_until", "_last")):
        where = numbered.select("unit_id", (F.col("_edge") - (1 if slot == "_until" else 0)).alias(slot), F.col("_n").alias(name))
        placed = placed.join(where, ["unit_id", slot])
    pieces = placed.select("unit_id", "_rank", "_s", F.explode(F.sequence(F.col("_first"), F.col("_last") - 1)).alias("_n"))
    best = pieces.groupBy("unit_id", "_n").agg(F.min_by("_s", "_rank").alias("_s"))
    spans = best.join(numbered.withColumnRenamed("_edge", "_slot"), ["unit_id", "_n"])
    spans = spans.join(numbered.select("unit_id", (F.col("_n") - 1).alias("_n"), (F.col("_edge") - 1).alias("_until")), ["unit_id", "_n"])
    if not whole:
        return spans.select("unit_id", "_slot", "_until", "_s")
    ordered = OrderedRows(spans, ["unit_id"], ["_slot"], segments).neighbour({"_was": F.col("_s"), "_ended": F.col("_until")})
    fresh = ~F.coalesce((F.col("_was") == F.col("_s")) | (F.col("_was").isNull() & F.col("_s").isNull()), F.lit(False)) | (F.col("_ended") + 1 != F.col("_slot"))
    runs = ordered.with_column("_new", F.coalesce(fresh, F.lit(True)).cast("long")).running_total({"_run": F.col("_new")}).frame()
    return runs.groupBy("unit_id", "_run").agg(F.min("_slot").alias("_slot"), F.max("_until").alias("_until"), F.first("_s").alias("_s")).drop("_run")


def _rule_values(entries: DataFrame, rules: DataFrame) -> DataFrame:
    return entries.join(rules.select("signal").distinct(), "signal", "left_semi")


def unit_status(
    entries: DataFrame,
    t_ms: int,
    rules: DataFrame,
    mapping: DataFrame,
    units: DataFrame | None = None,
    default_color: str = DEFAULT_COLOR,
) -> DataFrame:
    """Colour and text of each unit at ``t_ms``: the matching rule of highest priority,
    the first listed on ties, the default colour where none matches."""
    rows = _rule_values(entries, rules)
    best = _status(values_at(rows, t_ms), rules, map_devices(rows, mapping))
    every = map_devices(entries, mapping) if units is None else units
    return every.select("unit_id").distinct().join(best, "unit_id", "left").select(
        "unit_id",
        F.coalesce("_s.color", F.lit(default_color)).alias("color"),
        F.col("_s.text").alias("text"),
    )


def unit_status_ranges(
    entries: DataFrame,
    times: DataFrame,
    rules: DataFrame,
    mapping: DataFrame,
    segments: int | None = None,
) -> DataFrame:
    """``unit_id, from_ms, to_ms, color, text``: runs of ``times`` at which a unit shows
    the same, where a rule matches.  Rows grow with the changes, not with the times."""
    rows = _rule_values(entries, rules)
    held = held_values(rows, times, segments=segments)
    best = _status_ranges(held, rules, map_devices(rows, mapping), segments)
    timed = held.timed(held.timed(best, "_slot", "from_ms"), "_until", "to_ms")
    return timed.select("unit_id", "from_ms", "to_ms", "_s.color", "_s.text")


def unit_status_at(
    entries: DataFrame,
    times: DataFrame,
    rules: DataFrame,
    mapping: DataFrame,
    segments: int | None = None,
) -> DataFrame:
    """``unit_status`` for every ``t_ms`` of ``times``, for the units a rule matches then."""
    rows = _rule_values(entries, rules)
    held = held_values(rows, times, segments=segments)
    mapped = map_devices(rows, mapping)
    if held.numbered is None and len(held.probe.times) <= _FEW_PROBES:
        values = held.expanded(held.rows).select("t_ms", "device_id", "signal", *[f"_row.{c}" for c in VALUE_COLUMNS])
        best = _status(values, rules, mapped, "t_ms")
        return best.select("t_ms", "unit_id", F.col("_s.color").alias("color"), F.col("_s.text").alias("text"))
    best = _status_ranges(held, rules, mapped, segments, whole=False)
    return held.expanded(best).select("t_ms", "unit_id", F.col("_s.color").alias("color"), F.col("_s.text").alias("text"))


def missing_rule_signals(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Signals that rules use but no entry has."""
    seen = entries.select("signal").distinct()
    return rules.select("signal").distinct().join(seen, "signal", "left_anti")


def carrier_locations(entries: DataFrame, t_ms: int) -> DataFrame:
    """Where each carrier is at ``t_ms``; an empty location takes it off the map."""
    latest = values_at(entries.filter(F.col("signal") == CARRIER_SIGNAL), t_ms)
    # An empty text, false and 0 all mean "nowhere".
    nowhere = F.col("val_str").eqNullSafe("") | ~F.coalesce("val_bool", F.lit(True)) | (
        F.coalesce("val_int", F.lit(1)) == 0
    )
    return latest.filter(~nowhere).select(
        F.col("device_id").alias("carrier_id"), value_text().alias("unit_id"), "ts_ms"
    )


def carrier_count_class(count: Column) -> Column:
    return F.when(count >= 4, "4+").otherwise(count.cast("string"))


def unit_carrier_counts(entries: DataFrame, t_ms: int, units: DataFrame | None = None) -> DataFrame:
    counts = carrier_locations(entries, t_ms).groupBy("unit_id").agg(F.count(F.lit(1)).alias("carriers"))
    if units is not None:
        counts = units.select("unit_id").distinct().join(counts, "unit_id", "left").fillna(0, subset=["carriers"])
    return counts.withColumn("count_class", carrier_count_class(F.col("carriers")))


def carriers_at_unit(entries: DataFrame, t_ms: int, unit_id: str | None = None) -> DataFrame:
    """Carriers of each unit (or one) with the unit's label on every row.

    The label is the shortened id of a single carrier or the number of carriers.
    Rows stay one per carrier, so a crowded unit is never gathered into one list.
    """
    here = carrier_locations(entries, t_ms)
    if unit_id is not None:
        here = here.filter(F.col("unit_id") == unit_id)
    labels = here.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("carriers"), F.min("carrier_id").alias("_one")
    )
    one = F.col("_one")
    short = F.when(
        F.length(one) > _LABEL_CHARS, F.concat(F.lit("..."), F.right(one, F.lit(_LABEL_CHARS)))
    ).otherwise(one)
    label = F.when(F.col("carriers") == 1, short).otherwise(F.concat("carriers", F.lit("x")))
    return here.join(labels.select("unit_id", "carriers", label.alias("label")), "unit_id").select(
        "unit_id", "carrier_id", "carriers", "label"
    )


def carrier_entries(entries: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Location rows of carriers, optionally inside ``[start, end]``."""
    rows = entries.filter(F.col("signal") == CARRIER_SIGNAL)
    if start_ms is not None:
        rows = rows.filter(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        rows = rows.filter(F.col("ts_ms") <= end_ms)
    return rows.select(F.col("device_id").alias("carrier_id"), value_text().alias("location"), "ts_ms")


def layout_extent(layout: DataFrame) -> DataFrame:
    """Bounding box of the objects; rows whose two numbers cannot be read are skipped."""

    def pair(column: str):
        parts = F.split(column, ",")
        number = lambda i: script_number(F.get(parts, F.lit(i)))
        return F.size(parts) == 2, number(0), number(1)

    at_ok, x, y = pair("location")
    size_ok, w, h = pair("size")
    good = at_ok & size_ok
    for part in (x, y, w, h):
        good = good & part.isNotNull()
    return layout.filter(good).agg(
        F.min(x).alias("min_x"),
        F.min(y).alias("min_y"),
        F.max(x + w).alias("max_x"),
        F.max(y + h).alias("max_y"),
    )

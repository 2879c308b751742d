"""Held values and unit status as ranges of probes, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sigtrail.operators import asof, units
from sigtrail.schema import COLOR_RULE_SCHEMA, ENTRY_SCHEMA, MAPPING_SCHEMA

RULES = [(1, "a", "==", "5", "red", "", "five", 50), (2, "a", ">", "2", "", "blue", "", 50), (3, "b", "<", "3", "green", "", "low", 60), (4, "b", "!=", "9", "gray", "", "", 10)]


def entries(seed, n=150):
    rng = random.Random(seed)
    return [(i, "s", rng.randrange(400), f"d{rng.randrange(6)}", rng.choice("abc"), "", 1, None, rng.randrange(10), None, None) for i in range(n)]


def unit(device):
    return "left" if device in ("d0", "d1", "d4") else "right" if device in ("d2", "d3") else "d5"


MAPPING = [(1, "d0", "left"), (2, "d1", "left"), (3, "d4", "left"), (4, "d2", "right"), (5, "d3", "right")]


def state(data, t):
    last = {}
    for row in sorted(data, key=lambda r: (r[2], r[0])):
        if row[2] <= t:
            last[row[3], row[4]] = row
    return last


def status(data, t):
    best = {}
    supplied = {}
    for (device, signal), row in state(data, t).items():
        key = (unit(device), signal)
        if key not in supplied or device > supplied[key][0]:
            supplied[key] = (device, row[8])
    for (name, signal), (_, v) in supplied.items():
        for ord_, s, op, value, color, background, text, priority in RULES:
            hit = s == signal and {"==": v == int(value), ">": v > int(value), "<": v < int(value), "!=": v != int(value)}[op]
            if hit and (name not in best or (-priority, ord_) < best[name][0]):
                best[name] = ((-priority, ord_), color or background, text)
    return {(t, name, color, text) for name, (_, color, text) in best.items()}


@pytest.mark.parametrize("seed,segments", [(1, None), (2, 3)])
def test_status_of_every_probe(spark, seed, segments):
    data = entries(seed)
    frame, rules, mapping = spark.createDataFrame(data, ENTRY_SCHEMA), spark.createDataFrame(RULES, COLOR_RULE_SCHEMA), spark.createDataFrame(MAPPING, MAPPING_SCHEMA)
    times = [*range(-20, 450, 7), 10_000]
    probes = spark.createDataFrame([(t,) for t in times], "t_ms long")
    got = {tuple(r) for r in units.unit_status_at(frame, probes, rules, mapping, segments=segments).collect()}
    assert got == set().union(*(status(data, t) for t in times)) and len(times) > units._FEW_PROBES
    few = {tuple(r) for r in units.unit_status_at(frame, probes.filter("t_ms % 5 = 0"), rules, mapping, segments=segments).collect()}
    assert few == {r for r in got if r[0] % 5 == 0}
    ranges = units.unit_status_ranges(frame, probes, rules, mapping, segments=segments).collect()
    assert {(t, r.unit_id, r.color, r.text) for r in ranges for t in times if r.from_ms <= t <= r.to_ms} == got
    by_unit = sorted(map(tuple, ranges))
    assert all(not (a[0] == b[0] and a[3:] == b[3:] and times.index(a[2]) + 1 == times.index(b[1])) for a, b in zip(by_unit, by_unit[1:]))


@pytest.mark.parametrize("max_slots", [None, 1])
def test_ranges_grow_with_changes_only(spark, max_slots):
    data = entries(5, 60)
    frame = spark.createDataFrame(data, ENTRY_SCHEMA)
    few = asof.value_ranges(frame, spark.range(0, 500, 50).select(F.col("id").alias("t_ms")), max_slots=max_slots).collect()
    many = asof.value_ranges(frame, spark.range(0, 100_000).select(F.col("id").alias("t_ms")), max_slots=max_slots).collect()
    assert len(few) <= len(many) <= 60
    for ranges, times in ((few, range(0, 500, 50)), (many, range(0, 420, 13))):
        for t in times:
            assert {r.id for r in ranges if r.from_ms <= t <= r.to_ms} == {row[0] for row in state(data, t).values()}


def test_no_probes(spark):
    frame, none = spark.createDataFrame(entries(1, 5), ENTRY_SCHEMA), spark.createDataFrame([], "t_ms long")
    assert asof.value_ranges(frame, none).collect() == []
    rules, mapping = spark.createDataFrame(RULES, COLOR_RULE_SCHEMA), spark.createDataFrame(MAPPING, MAPPING_SCHEMA)
    assert units.unit_status_at(frame, none, rules, mapping).collect() == []


def test_many_rules_of_a_signal_are_found_not_tried(spark):
    rng = random.Random(9)
    signs = {">": lambda v, r: v > r, ">=": lambda v, r: v >= r, "<": lambda v, r: v < r, "<=": lambda v, r: v <= r, "==": lambda v, r: v == r, "!=": lambda v, r: v != r}
    rules = [(i, "a", op := rng.choice(["==", ">", ">=", "<", "<="] if i % 50 else ["!="]), str(rng.randrange(300, 700) if op != "==" else rng.randrange(1000)), f"c{i}", "", "", rng.randrange(5)) for i in range(10_000)]
    rules += [(10_001, "a", ">", "word", "never", "", "", 99), (10_002, "a", "=~", "1", "never", "", "", 99), (10_003, "b", "!=", "ON", "b", "", "", 1)]
    data = [(i, "s", 0, f"d{i}", "a", "", 1, None, i * 3, None, None) for i in range(340)] + [(900, "s", 0, "on", "b", "", 0, True, None, None, None), (901, "s", 0, "off", "b", "", 0, False, None, None, None)]
    mapping = spark.createDataFrame([(1, "nobody", "x")], MAPPING_SCHEMA)
    frame = spark.createDataFrame(data, ENTRY_SCHEMA)
    got = {r.unit_id: r.color for r in units.unit_status(frame, 5, spark.createDataFrame(rules, COLOR_RULE_SCHEMA), mapping, default_color="none").collect()}

    def best(v):
        held = [((-r[7], r[0]), r[4]) for r in rules if r[1] == "a" and r[3] != "word" and r[2] in signs and signs[r[2]](v, int(r[3]))]
        return min(held)[1] if held else "none"

    assert {k: v for k, v in got.items() if k.startswith("d")} == {f"d{i}": best(i * 3) for i in range(340)}
    assert (got["on"], got["off"]) == ("none", "b")

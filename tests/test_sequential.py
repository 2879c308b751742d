"""Order-dependent operators against a plain loop on random rows, also when the
keys are cut into segments and ties are common."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sigtrail.operators import asof, merge, paging, resolve
from sigtrail.operators import transitions as tact
from sigtrail.plans import ordered
from sigtrail.plans.percentiles import exact_percentiles
from sigtrail.plans.slots import asof_rows
from sigtrail.schema import ENTRY_SCHEMA, RULE_SCHEMA, TIME_ORDER

SEGMENTS = [None, 7]


def rows(seed: int, n: int, span: int, devices: int, values: int, sources=("a",)):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # One device has most of the rows.
        device = 0 if rng.random() < 0.7 else rng.randrange(devices)
        out.append(
            (i, rng.choice(sources), rng.randrange(span), f"D{device}", "S", "", 1, None, rng.randrange(values), None, None)
        )
    return out


def frame(spark, data):
    return spark.createDataFrame(data, ENTRY_SCHEMA)


def in_order(data):
    return sorted(data, key=lambda r: (r[2], r[1], r[0]))


@pytest.mark.parametrize("segments", SEGMENTS)
def test_ordered_columns(spark, segments):
    data = rows(1, 600, 80, 4, 5)
    values = {"v": F.when(F.col("val_int") > 2, F.col("val_int"))}
    ranged = ordered.OrderedRows(frame(spark, data), ["device_id"], TIME_ORDER, segments)
    assert ranged.segmented == (segments is not None)
    out = (
        ranged.neighbour({"before": F.col("id")})
        .neighbour({"after": F.col("id")}, backward=True)
        .known(values)
        .known({"w": values["v"]}, backward=True)
        .running_total({"total": F.col("val_int")})
    )
    got = {r["id"]: (r["before"], r["after"], r["v"], r["w"], r["total"]) for r in out.frame().collect()}
    assert len(got) == len(data)
    want = {}
    for device in {r[3] for r in data}:
        mine = [r for r in in_order(data) if r[3] == device]
        last, total = None, 0
        for i, r in enumerate(mine):
            last = r[8] if r[8] > 2 else last
            total += r[8]
            later = next((q[8] for q in mine[i:] if q[8] > 2), None)
            want[r[0]] = (
                mine[i - 1][0] if i else None, mine[i + 1][0] if i + 1 < len(mine) else None, last, later, total,
            )
    assert got == want


@pytest.mark.parametrize("segments", SEGMENTS)
def test_position_without_keys(spark, segments):
    data = rows(2, 500, 50, 3, 5)
    got = ordered.position(frame(spark, data), [], TIME_ORDER, segments=segments).collect()
    assert {r["id"]: r["pos"] for r in got} == {r[0]: i for i, r in enumerate(in_order(data))}


def loop_transitions(data, s, e):
    out, armed = [], None
    for r in in_order(data):
        if armed is None:
            armed = r[2] if s(r[8]) else None
        elif e(r[8]):
            out.append((armed, r[2]))
            armed = None
    return out


@pytest.mark.parametrize("segments", SEGMENTS)
@pytest.mark.parametrize("seed", [3, 4])
def test_transitions(spark, segments, seed):
    data = rows(seed, 700, 150, 1, 10)
    rules = spark.createDataFrame(
        [
            ("both", "a-to-b", "D0", "S", "greater", "3", "D0", "S", "less", "6", 5.0, 2.0),
            ("apart", "a-to-b", "D0", "S", "equals", "1", "D0", "S", "equals", "2.0", None, None),
            ("loop", "cycle", "D0", "S", "not-equals", "4", None, None, None, None, 1.0, None),
            ("none", "a-to-b", "D0", "S", "equals", "x", "D0", "S", "not-empty", None, None, None),
        ],
        RULE_SCHEMA,
    )
    got = {}
    for r in tact.transitions(frame(spark, data), rules, segments=segments).collect():
        got.setdefault(r["rule_id"], []).append((r["start_ms"], r["end_ms"]))
    loop = [r[2] for r in in_order(data) if r[8] != 4]
    assert sorted(got["both"]) == sorted(loop_transitions(data, lambda v: v > 3, lambda v: v < 6))
    assert sorted(got["apart"]) == sorted(loop_transitions(data, lambda v: v == 1, lambda v: v == 2))
    assert sorted(got["loop"]) == sorted(zip(loop, loop[1:]))
    assert "none" not in got


def loop_dedupe(data, window, key):
    kept, last = [], {}
    for r in in_order(data):
        k = key(r)
        p = last.get(k)
        if p and p[3:5] == r[3:5] and p[8] == r[8] and r[2] - p[2] < window:
            continue
        kept.append(r[0])
        last[k] = r
    return sorted(kept)


@pytest.mark.parametrize("segments", SEGMENTS)
@pytest.mark.parametrize("short_run", [1000, 0])
@pytest.mark.parametrize("scope", ["adjacent", "per_signal"])
def test_dedupe(spark, monkeypatch, segments, short_run, scope):
    monkeypatch.setattr(merge, "_SHORT_RUN", short_run)
    monkeypatch.setattr(merge, "_BLOCK_MS", 64)
    data = rows(5, 900, 700, 2, 2, ("a", "b"))
    key = (lambda r: "") if scope == "adjacent" else (lambda r: r[3])
    got = merge.dedupe(frame(spark, data), 20, scope, segments=segments)
    assert sorted(r["id"] for r in got.collect()) == loop_dedupe(data, 20, key)


def test_dedupe_one_long_run(spark, monkeypatch):
    """A single value reported all the time: one run over many blocks."""
    monkeypatch.setattr(merge, "_SHORT_RUN", 10)
    monkeypatch.setattr(merge, "_BLOCK_MS", 128)
    rng = random.Random(6)
    data = [(i, "ab"[i % 2], rng.randrange(4000), "D", "S", "", 1, None, 1, None, None) for i in range(3000)]
    for window in (3, 50, 300):
        got = merge.dedupe(frame(spark, data), window)
        assert sorted(r["id"] for r in got.collect()) == loop_dedupe(data, window, lambda r: "")


@pytest.mark.parametrize("block_ms,window", [(8, 5), (8, 40), (3, 2)])
def test_dedupe_over_a_tree_of_blocks(spark, monkeypatch, block_ms, window):
    """Thousands of blocks, joined four at a time over several levels."""
    monkeypatch.setattr(merge, "_SHORT_RUN", 10)
    monkeypatch.setattr(merge, "_BLOCK_MS", block_ms)
    monkeypatch.setattr(merge, "_FANOUT", 4)
    rng = random.Random(block_ms)
    data = [(i, "ab"[i % 2], t, "D", "S", "", 1, None, 1, None, None) for i, t in enumerate(sorted(rng.sample(range(9000), 7000)))]
    got = merge.dedupe(frame(spark, data), window)
    assert sorted(r["id"] for r in got.collect()) == loop_dedupe(data, window, lambda r: "")


def test_dedupe_single_source(spark):
    data = rows(7, 50, 20, 1, 1)
    assert merge.dedupe(frame(spark, data)).count() == 50


@pytest.mark.parametrize("segments", SEGMENTS)
def test_changed_only(spark, segments):
    data = rows(8, 500, 60, 3, 2)
    last, want = {}, []
    for r in in_order(data):
        if last.get(r[3]) != r[8]:
            want.append(r[0])
        last[r[3]] = r[8]
    got = paging.changed_only(frame(spark, data), segments=segments)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("max_slots", [10_000, 1])
@pytest.mark.parametrize("segments", SEGMENTS)
def test_values_at_times(spark, segments, max_slots):
    data = rows(9, 400, 90, 4, 50)
    times = [0, 13, 14, 40, 89, 200, -5]
    probes = spark.createDataFrame([(t,) for t in times], "t_ms long")
    got = asof.values_at_times(frame(spark, data), probes, segments=segments, max_slots=max_slots)
    want = set()
    for t in times:
        latest = {}
        for r in in_order(data):
            if r[2] <= t:
                latest[r[3]] = r[0]
        want |= {(t, d, i) for d, i in latest.items()}
    assert {(r["t_ms"], r["device_id"], r["id"]) for r in got.collect()} == want


@pytest.mark.parametrize("segments", SEGMENTS)
def test_nearest_event(spark, segments):
    data = rows(10, 120, 3000, 2, 5)
    probes = [(f"D{d}", "S", t) for d in range(3) for t in range(0, 3000, 37)]
    got = asof.nearest_event(
        frame(spark, data), spark.createDataFrame(probes, "device_id string, signal string, t_ms long"), 25, segments
    )
    want = {}
    for device, _, t in probes:
        best, found = 25, None
        for r in in_order(data):
            if r[3] == device and abs(r[2] - t) < best:
                best, found = abs(r[2] - t), r[2]
        want[device, t] = found
    assert {(r["device_id"], r["t_ms"]): r["nearest_ms"] for r in got.collect()} == want


@pytest.mark.parametrize("segments", SEGMENTS)
def test_asof_rows_is_strict_where_shifted(spark, segments):
    marks = spark.createDataFrame([(t,) for t in (5, 10, 10, 20)], "m long")
    probes = spark.createDataFrame([(t,) for t in (4, 5, 10, 11, 25)], "t_ms long")
    got = asof_rows(marks, probes, [], ["m"], {"m": F.col("m")}, segments=segments)
    assert {(r["t_ms"], r["m"]) for r in got.collect()} == {(4, None), (5, 5), (10, 10), (11, 10), (25, 20)}


@pytest.mark.parametrize("segments", SEGMENTS)
def test_moving_average(spark, monkeypatch, segments):
    monkeypatch.setattr(tact, "_BLOCK_ROWS", 8)
    found = [("r", 10 * i, 10 * i + 5, (7 * i) % 11, "ok") for i in range(100)]
    df = spark.createDataFrame(found, "rule_id string, start_ms long, end_ms long, duration_ms long, status string")
    got = tact.trend(df, "moving", window=6, segments=segments).orderBy("time_ms").collect()
    durations = [f[3] for f in found]
    for i, r in enumerate(got):
        part = durations[max(0, i - 5) : i + 1]
        assert r["count"] == len(part) and abs(r["value"] - sum(part) / len(part)) < 1e-9
    assert len(got) == 100


def test_resolve_last(spark):
    data = [
        (0, "a", 0, "D", "S", "", 3, None, None, None, "x"),
        (1, "a", 0, "D", "S", "", 1, None, 7, None, None),
        (2, "a", 0, "D", "S", "", 0, True, None, None, None),
        (0, "b", 0, "D", "S", "", 0, True, None, None, None),
    ]
    got = {(r["source_id"], r["id"]): (r["val_type"], r["val_int"]) for r in resolve.resolve_signal_types(frame(spark, data), "last").collect()}
    assert got[("a", 2)] == (1, 1) and got[("b", 0)] == (0, None)


def test_exact_percentiles(spark):
    rng = random.Random(11)
    values = [rng.randrange(1 << 22) for _ in range(999)] + [1 << 21] * 50
    df = spark.createDataFrame([("k", v) for v in values], "k string, v long")
    points = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}
    row = exact_percentiles(df, ["k"], "v", points).first()
    ranked = sorted(values)
    for name, p in points.items():
        rank = p * (len(ranked) - 1)
        low = int(rank)
        high = min(low + 1, len(ranked) - 1)
        assert row[name] == pytest.approx(ranked[low] + (ranked[high] - ranked[low]) * (rank - low))


def test_deep_pages_use_positions(spark, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 10)
    data = rows(12, 300, 40, 4, 5)
    df = frame(spark, data)
    by_device = sorted(data, key=lambda r: (r[3], r[1], r[0]))
    page = paging.page_rows(df, "deviceId", "asc", 3, 20).collect()
    assert [r["id"] for r in page] == [r[0] for r in by_device[40:60]]
    page = paging.page_rows(df, "deviceId", "desc", 2, 20).collect()
    assert [r["id"] for r in page] == [r[0] for r in by_device[::-1][20:40]]
    assert [r["id"] for r in paging.entries_range(df, 50, 60).collect()] == list(range(50, 60))

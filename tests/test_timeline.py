from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sigtrail.operators import asof, units
from sigtrail.schema import ENTRY_SCHEMA
from sigtrail.sinks.timeline import append_timeline, fitting_interval, open_timeline

STEP = 100


def rows(seed=1, n=120, low=0, high=1200, first=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = rng.choice([rng.randrange(low, high), rng.randrange(low, high) // STEP * STEP])
        if 400 <= t < 700:  # intervals without rows
            t = low
        out.append((first + i, rng.choice("ab"), t, f"d{rng.randrange(3)}", rng.choice(["x", "CurrentLocation"]), "", 3, None, None, None, rng.choice(["", "u1", "u2"])))
    return out


def found(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def frame(spark):
    return lambda data: spark.createDataFrame(data, ENTRY_SCHEMA)


def test_every_boundary_like_the_scan(spark, frame, tmp_path):
    entries = frame(rows())
    line = append_timeline(entries, str(tmp_path / "t"), STEP)
    for t in (-1, 99, 100, 550, 1199, 10**15):
        assert found(asof.values_at(line.upto(t), t)) == found(asof.values_at(entries, t))
        assert found(units.carrier_locations(line.upto(t), t)) == found(units.carrier_locations(entries, t))


@pytest.mark.parametrize("start,end", [(-50, -10), (250, 1000), (450, 500)])
def test_windows_like_the_scan(spark, frame, tmp_path, start, end):
    entries = frame(rows(2))
    line = append_timeline(entries, str(tmp_path / "t"), STEP)
    near = line.around(start, end)
    signals = entries.select("device_id", "signal").distinct()
    assert found(asof.boundary_values(near, start, end, signals)) == found(asof.boundary_values(entries, start, end, signals))
    assert found(asof.chunk_with_lead_in(near, start, end)) == found(asof.chunk_with_lead_in(entries, start, end))
    assert found(asof.state_intervals(near, start, end)) == found(asof.state_intervals(entries, start, end))
    assert found(asof.chunk(near, start, end)) == found(asof.chunk(entries, start, end))
    probes = spark.createDataFrame([(start,), (end,), ((start + end) // 2,)], "t_ms long")
    assert found(asof.values_at_times(near, probes)) == found(asof.values_at_times(entries, probes))


def test_appended_parts_make_the_same_snapshots(spark, frame, tmp_path):
    data = rows(3, 160)
    whole = append_timeline(frame(data), str(tmp_path / "whole"), STEP)
    path = str(tmp_path / "parts")
    for low, high in ((0, 300), (300, 800), (800, 900), (900, 2000)):
        append_timeline(frame([r for r in data if low <= r[2] < high]), path, STEP)
    parts = open_timeline(spark, path)
    assert parts.batches == 4
    assert found(parts.intervals) == found(whole.intervals)
    for kind in ("before", "after"):
        state = [found(spark.read.parquet(f"{line.path}/{kind}").drop("batch")) for line in (parts, whole)]
        assert state[0] == state[1]
    assert found(parts.entries()) == found(frame(data))


def test_a_question_reads_one_interval_and_its_snapshots(spark, frame, tmp_path):
    line = append_timeline(frame(rows(4)), str(tmp_path / "t"), STEP)
    files = line.upto(850).inputFiles()
    assert {f.split("/t/")[1].rsplit("/", 2)[0] for f in files} == {"entries/slot=8", "before/interval=5"}
    folders = {f.split("/t/")[1].rsplit("/", 2)[0] for f in line.around(210, 320).inputFiles()}
    assert folders == {"entries/slot=2", "entries/slot=3", "before/interval=2", "after/interval=3"}


def test_many_intervals_are_pruned_from_a_listing(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr("sigtrail.sinks.timeline._MOST_PATHS", 2)
    entries = frame(rows(6))
    line = append_timeline(entries, str(tmp_path / "t"), STEP)
    assert found(line.entries()) == found(entries)
    assert found(line.entries(1, 8)) == found(entries.where("ts_ms BETWEEN 100 AND 899"))


def test_late_rows_are_refused_and_leave_no_trace(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    entries = frame(rows(5, high=300))
    append_timeline(entries, path, STEP)
    with pytest.raises(ValueError, match="stored"):
        append_timeline(frame(rows(6, 5, 250, 600)), path)
    line = append_timeline(frame([]), path)
    assert (line.batches, found(line.entries())) == (1, found(entries))


def test_an_append_that_failed_half_way_is_invisible(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    entries = frame(rows(5, high=300))
    line = append_timeline(entries, path, STEP)
    stray = frame(rows(9, 10, 300, 400)).withColumns({"slot": F.lit(3), "batch": F.lit(1)})
    stray.write.mode("append").partitionBy("slot", "batch").parquet(f"{path}/entries")
    stray.drop("slot").withColumn("interval", F.lit(2)).write.mode("append").partitionBy("interval", "batch").parquet(f"{path}/after")
    assert found(line.entries()) == found(entries)
    assert found(asof.boundary_values(line.around(250, 10**6), 250, 10**6, None)) == found(asof.boundary_values(entries, 250, 10**6, None))
    more = frame(rows(7, 20, 700, 900, first=500))
    line = append_timeline(more, path)
    assert found(line.entries()) == found(entries.unionByName(more))


def test_an_interval_for_a_share_of_rows(spark, frame):
    entries = frame(rows(8, 600, 0, 100_000))
    step = fitting_interval(entries, 0.1)
    assert 100_000 // step * 6 <= 60 + 6
    assert fitting_interval(frame([])) == 1

"""Inputs that the given tables don't hold: blank keys, odd names, many patterns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sigtrail import session
from sigtrail.adapters import int_entries, mixed_entries
from sigtrail.functions.classify import signal_pattern
from sigtrail.operators import paging, units
from sigtrail.operators.filters import EntryFilter, filter_entries, search_predicate, search_signals
from sigtrail.plans import ordered
from sigtrail.plans.ordered import OrderedRows, position
from sigtrail.sinks import store
from sigtrail.sources.ingest import read_logs
from sigtrail.sources.secs import read_secs_records, classify_secs
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def gaps(spark):
    """Entries of which a third have no value."""
    rows = mixed_entries(spark, SMALL)
    empty = F.col("id") % 3 == 0
    return rows.withColumns({c: F.when(~empty, F.col(c)) for c in ("val_bool", "val_int", "val_float", "val_str")})


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_after_a_row_reach_rows_without_a_key(gaps, direction):
    key = paging.sort_expression("value").alias("key")
    want = [(r["source_id"], r["id"]) for r in paging.sort_entries(gaps, "value", direction).collect()]
    got, last = [], None
    while True:
        rows = paging.page_rows(gaps, "value", direction, 1, 170) if last is None else paging.page_after(gaps, "value", *last, size=170, direction=direction)
        found = rows.select("source_id", "id", key).collect()
        if not found:
            break
        got += [(r["source_id"], r["id"]) for r in found]
        last = (found[-1]["key"], found[-1]["source_id"], found[-1]["id"])
    assert got == want


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_index_of_time_counts_rows_without_a_key_last(gaps, direction):
    order = paging.sort_entries(gaps, "value", direction).select("ts_ms").collect()
    for at in (0, len(order) // 2, len(order) - 1):
        probe = order[at]["ts_ms"]
        want = next(i for i, r in enumerate(order) if r["ts_ms"] >= probe)
        assert paging.index_of_time(gaps, probe, column="value", direction=direction).first()[0] == want


def test_pages_have_the_size_asked_for(spark):
    entries = int_entries(spark, SMALL)
    n = entries.count()
    assert paging.page_rows(entries, "timestamp", "asc", 1, n + 5).count() == n
    assert paging.page_rows(entries, "timestamp", "asc", 0, 3).count() == 3
    with pytest.raises(ValueError):
        paging.page_rows(entries, "timestamp", "asc", 1, 0)


def test_only_hot_keys_are_cut(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(900)], "k string, i long")
    spark.conf.set("spark.sigtrail.maxRowsPerTask", "10")
    try:
        cut = OrderedRows(rows, ["k"], ["i"])
        sizes = {(r["k"], r["_segment"]): r["count"] for r in cut.df.groupBy("k", "_segment").count().collect()}
        assert max(sizes.values()) <= 10
        assert all(segment == 0 for k, segment in sizes if k != "hot")
        want = {i: n for n, i in enumerate(i for i in range(900) if i % 3)}
        got = {r["i"]: r["pos"] for r in position(rows, ["k"], ["i"]).collect() if r["k"] == "hot"}
        assert got == want
    finally:
        spark.conf.unset("spark.sigtrail.maxRowsPerTask")


def test_more_segments_than_four_thousand(spark, monkeypatch):
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: df)  # spares the test 4 500 files
    rows = spark.range(9000).select(F.lit("k").alias("k"), "id")
    spark.conf.set("spark.sigtrail.maxRowsPerTask", "4")
    try:
        cut = OrderedRows(rows, ["k"], ["id"])
        sizes = [r["count"] for r in cut.df.groupBy("_segment").count().collect()]
        assert len(sizes) > 4096 and max(sizes) <= 4
    finally:
        spark.conf.unset("spark.sigtrail.maxRowsPerTask")


def test_stages_need_a_shared_folder_and_can_be_dropped(spark, monkeypatch):
    import os

    stage = session.cut_lineage(spark.range(3))
    folder = stage.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    session.drop_stages(spark)
    assert not os.path.exists(folder)

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        session.shared_dir(Cluster)


@pytest.mark.parametrize("mark", ["\x85", " ", " "])
def test_only_a_newline_ends_a_line(spark, lines, mark):
    log = read_logs(spark, [lines(f"2024-03-01 08:00:00 [A] left{mark}right\n2024-03-01 08:00:01 [A] next\n2024-03-01 08:00:02 [A] last\n")])
    assert [r["val_str"] for r in log.entries.orderBy("id").collect()] == [f"left{mark}right", "next", "last"]
    text = f"2024-03-01 08:00:00.100 [ADD=C1, X7] [Note=a{mark}b] [Priority=3]\n"
    rows = read_logs(spark, [lines(text, "mcs.log")], "mcs_log")
    assert rows.errors.count() == 0
    assert {r["signal"]: r["val_str"] for r in rows.entries.collect()}["Note"] == f"a{mark}b"


def test_paths_with_blanks_and_pattern_characters(spark, tmp_path):
    folder = tmp_path / "in dir [1]"
    folder.mkdir()
    (folder / "a b{x}*.log").write_text("2024-03-01 08:00:00 [A] one\n")
    (folder / "c%20d.log").write_text("2024-03-01 08:00:00 [A] two\n")
    log = read_logs(spark, [str(tmp_path / "in dir ?1?" / "*.log")], resolve=False)
    assert sorted(r["val_str"] for r in log.entries.collect()) == ["one", "two"]


def test_indented_headers_start_a_message(spark, lines):
    body = "TransactionTime : 2024/03/01 08:00:00.000 S1F1 W, - Are You There [SystemByte = {}]\n<L, 0>.\n"
    text = "".join(f"{pad}@2024/03/01 08:00:0{i}.000^INFO^SECS^RECV\n{body.format(i)}" for i, pad in enumerate(["", "  ", "\t", ""]))
    got = classify_secs(read_secs_records(spark, [lines(text)])).orderBy("id").collect()
    assert [r["system_byte"] for r in got] == [0, 1, 2, 3]
    assert [r["id"] for r in got] == sorted({r["id"] for r in got})


def test_orphans_with_names_that_look_like_numbers(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = int_entries(spark, SMALL).limit(20)
    names = ["001", "1.1", "1.10", "2024-01-01"]
    for name in names:
        store.write_entries(rows.withColumn("source_id", F.lit(name)), path)
    known = spark.createDataFrame([("001",), ("1.1",)], "source_id string")
    assert store.remove_orphans(spark, path, known) == 2
    assert {r[0] for r in store.stored_sources(spark, path).collect()} == {"001", "1.1"}


def test_a_regex_is_judged_by_the_engine_that_runs_it(spark):
    entries = int_entries(spark, SMALL)
    n = entries.count()
    count = lambda **o: entries.filter(search_predicate(regex=True, ignore_regex_case=True, **o)).count()
    assert count(text=r"\p{L}+") == n
    assert count(text="(?P<a>v)") == 0  # invalid here: searched as plain text
    assert count(text="VIEW") == entries.filter("signal = 'view'").count()
    assert filter_entries(entries, EntryFilter(text="VI.W", regex=True, ignore_regex_case=True)).count() == count(text="VIEW")
    signals = spark.createDataFrame([("D1", "view", "integer")], "device_id string, signal string, signal_type string")
    assert search_signals(signals, r"\p{Ll}+", regex=True).count() == 1
    assert search_signals(signals, "(?P<a>v)", regex=True).count() == 0
    named = spark.createDataFrame([("X_ERROR",)], "s string").select(signal_pattern(F.col("s"), [("Bad", "(?P<a>X)"), ("Worse", "("), ("Good", r"\p{Lu}_ERR")]).alias("p"))
    assert named.first()["p"] == "good"


def test_many_wildcard_patterns_are_joined_on_their_ends(spark):
    devices = [f"L{i % 70}.D{i}@x" for i in range(300)] + ["alone"]
    patterns = [(f"L{i}.*", 5_000_000_000 + i, f"u{i}") for i in range(60)] + [(f"*D{i}@x", 100 + i, f"v{i}") for i in range(0, 2100, 3)] + [(f"*{i}@*", 10 + i, f"w{i}") for i in range(250, 2000)] + [("alone", 7, "exact")]
    mapping = spark.createDataFrame(patterns, "pattern string, ord long, unit_id string")
    names = spark.createDataFrame([(d,) for d in devices], "device_id string")
    mapped = units.map_devices(names, mapping)
    assert "CartesianProduct" not in mapped._jdf.queryExecution().executedPlan().toString()

    def plain(device):
        import fnmatch

        fits = [(o, u) for p, o, u in patterns if fnmatch.fnmatchcase(device, p)]
        return min(fits)[1] if fits else device.rsplit(".", 1)[-1].split("@")[0]

    assert {r["device_id"]: r["unit_id"] for r in mapped.collect()} == {d: plain(d) for d in devices}


def test_patterns_open_at_both_ends_meet_the_devices_with_their_rarest_piece(spark):
    import fnmatch

    devices = [f"line-{i % 9}.cell{i}.press@{i * 7 % 100}" for i in range(400)] + ["", "a", "ab", "100%_x"]
    patterns = [(f"*cell{i}.press*", 9000 + i, f"p{i}") for i in range(0, 5000, 2)] + [("*s@9*", 50, "nine"), ("*%_*", 3, "odd"), ("*b*", 99_990, "b"), ("*line-3*cell*", 99_980, "three"), ("**", 99_999, "any"), ("*s@9*", 70, "later")]
    mapping = spark.createDataFrame(patterns, "pattern string, ord long, unit_id string")
    mapped = units.map_devices(spark.createDataFrame([(d,) for d in devices], "device_id string"), mapping)
    want = {d: min((o, u) for p, o, u in patterns if fnmatch.fnmatchcase(d, p))[1] for d in devices}
    assert {r["device_id"]: r["unit_id"] for r in mapped.collect()} == want
    assert "CartesianProduct" not in mapped._jdf.queryExecution().executedPlan().toString()


def test_a_large_rank_doesnt_win(spark):
    mapping = spark.createDataFrame([("D*", 1 << 33, "far"), ("D1*", 5, "near")], "pattern string, ord long, unit_id string")
    names = spark.createDataFrame([("D1x",)], "device_id string")
    assert units.map_devices(names, mapping).first()["unit_id"] == "near"

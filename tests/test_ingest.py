"""Reading many files: heads, routing of mixed formats, types settled from states."""

from __future__ import annotations

import inspect

import pytest

from sigtrail.operators.resolve import apply_types, merge_type_states, resolve_signal_types, type_state
from sigtrail.schema import ENTRY_SCHEMA
from sigtrail.sources import detect, ingest
from sigtrail.sources.detect import detect_format, read_head
from sigtrail.sources.ingest import read_logs
from sigtrail.sources.plc import read_csv_signal, read_plc_debug
from sigtrail.streaming.ingest import compact_types, stream_entries, streamed_entries, streamed_types

DEBUG = "2024-03-07 06:11:{:02d}.000 [INFO] [Line/{}@D1] [ C :{}] ({}) : {} "
TAB = "2024-03-07 06:11:{:02d}.000 [] Line/{}@D1\t{}\tx\t{}\t\t\t\t\t2024-03-07 06:11:05.123"
CSV = "2024-03-07 06:11:{:02d}.000, Line/{}@D1, {}, {}"


def found(df):
    return sorted(map(str, df.collect()))


def test_bytes_read_do_not_grow_with_the_file(tmp_path):
    line = DEBUG.format(1, "U1", "Sig", "integer", 7) + "\r\n"
    small, large = tmp_path / "small.log", tmp_path / "large.log"
    small.write_text("\n \n" + line * 2000)
    large.write_text("\n \n" + line * 400_000)
    heads = [read_head(f.as_uri()) for f in (small, large)]
    assert heads[0] == heads[1]
    assert heads[1][1] <= 1 << 17 and large.stat().st_size > 1 << 24
    assert len(heads[0][0]) == detect.HEAD_LINES and not heads[0][0][0].endswith("\r")


def test_heads_of_odd_files(tmp_path):
    import gzip

    def head(data, name="f.log"):
        (tmp_path / name).write_bytes(data)
        return read_head((tmp_path / name).as_uri())[0]

    assert head(b"") == [] and head(b"\n \n\t\r\n") == []
    assert head(b"no end of line") == ["no end of line"]
    assert head("ü\n".encode() + b"\xff\n") == ["ü", "�"]
    assert head(b"x" * (6 << 20)) == ["x" * (4 << 20)]
    assert head(gzip.compress(b"one\ntwo\n"), "f.log.gz") == ["one", "two"]
    assert head(b"a\n", "odd name %41 #1.log") == ["a"]


def test_detection_scans_no_text(spark, lines):
    path = lines("\n".join(TAB.format(i, "U1", "S", i) for i in range(30)))
    plan = detect_format(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "content" not in plan
    assert [r.format for r in detect_format(spark, path).collect()] == ["plc_tab"]


@pytest.fixture
def folder(tmp_path):
    """Many small files of four formats, some without lines."""
    root = tmp_path / "logs"
    root.mkdir()
    for i in range(40):
        kind = [
            [DEBUG.format(k, f"U{i}", "S", "integer", k) for k in range(12)],
            [TAB.format(k, f"U{i}", "S", k) for k in range(12)],
            [CSV.format(k, f"U{i}", "S", k % 2) for k in range(12)],
            [CSV.format(k, f"U{i}", "T", "on") for k in range(12)],
        ][i % 4]
        (root / f"file {i} [x].log").write_text("\n".join(kind) + "\n")
    (root / "empty.log").write_text("")
    (root / "blank.log").write_text("\n\n")
    return root


def by_file(entries):
    """Rows of each file in line order, without ids, which depend on how files share tasks."""
    out = {}
    for row in sorted(entries.collect(), key=lambda r: r.id):
        out.setdefault(row.source_id.rsplit("/", 1)[1], []).append(tuple(row)[2:])
    return out


def test_mixed_files_like_each_format_alone(spark, folder):
    log = read_logs(spark, str(folder))
    assert log.parser_name == "merged"
    whole = by_file(log.entries)
    assert len(whole) == 40 and {len(v) for v in whole.values()} == {12} and log.errors.count() == 0
    for fmt, members in (("plc_debug", "[048]"), ("plc_tab", "[159]"), ("csv_signal", "[2367]")):
        alone = by_file(read_logs(spark, f"{folder}/file {members} *.log", fmt).entries)
        assert alone == {name: rows for name, rows in whole.items() if name in alone} and len(alone) >= 3


def test_no_list_of_files_in_driver_or_plan(spark, folder):
    source = inspect.getsource(ingest)
    assert ".collect()" not in source and "toPandas" not in source
    plan = read_logs(spark, str(folder)).entries._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "file%20" not in plan


def test_unknown_and_missing_lines(spark, folder):
    (folder / "zzz.log").write_text("what is this\n" * 5)
    with pytest.raises(ValueError, match="no suitable format found for .*zzz.log"):
        read_logs(spark, str(folder))
    with pytest.raises(ValueError, match="no log lines"):
        read_logs(spark, str(folder / "blank.log"))


def entry(i, source, signal, kind, value):
    cells = {"b": (0, value, None, None, None), "i": (1, None, value, None, None), "f": (2, None, None, value, None), "s": (3, None, None, None, value)}
    return (i, source, i, "d", signal, "", *cells[kind])


def test_states_merge_in_any_order_and_twice(spark):
    values = [("b", True), ("i", 1), ("i", 0), ("i", 7), ("f", 1.5), ("s", "x"), ("s", None)]
    rows = [entry(i * 10 + j, s, f"n{i}", *values[(i * 3 + j * k) % 7]) for i in range(14) for j, k in enumerate((1, 2, 5)) for s in ("a", "b")]
    entries = spark.createDataFrame(rows, ENTRY_SCHEMA)
    parts = [type_state(entries.where(f"id % 3 = {k}")) for k in (2, 0, 1, 0)]
    merged = merge_type_states(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]))
    twice = merge_type_states(merged.unionAll(merge_type_states(parts[1].unionAll(parts[2]))))
    for rule in ("any", "last"):
        want = found(resolve_signal_types(entries, rule))
        assert found(apply_types(entries, merged, rule)) == want
        assert found(apply_types(entries, twice, rule)) == want


@pytest.mark.parametrize("fmt,line", [("csv_signal", lambda k, v: CSV.format(k, "U1", "S", v)), ("plc_debug", lambda k, v: DEBUG.format(k, "U1", "S", "boolean" if v in "01" else "integer", v))])
def test_streamed_types_settle_with_late_values(spark, tmp_path, fmt, line):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()

    def take():
        stream_entries(spark, str(source), fmt, store, str(tmp_path / "cp"), max_files_per_batch=1).awaitTermination()

    (source / "a.log").write_text("\n".join(line(k, str(k % 2)) for k in range(5)) + "\n")
    take()
    (source / "b.log").write_text("\n".join(line(k, str(k % 2)) for k in range(5)) + "\n" + line(9, "44") + "\n")
    take()
    (source / "c.log").write_text(line(10, "1") + "\n")
    take()
    read = {"csv_signal": read_csv_signal, "plc_debug": read_plc_debug}[fmt]
    want = found(read(spark, str(source)).entries)
    assert found(streamed_entries(spark, store, fmt)) == want
    state = found(streamed_types(spark, store))
    for _ in range(2):
        compact_types(spark, store)
        assert found(streamed_types(spark, store)) == state
        assert found(streamed_entries(spark, store, fmt)) == want


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for name, value in (("a", "1"), ("b", "17")):
        (source / f"{name}.log").write_text("\n".join(CSV.format(k, "U1", "S", value) for k in range(3)) + "\n")
        stream_entries(spark, str(source), "csv_signal", store, str(tmp_path / "cp"), max_files_per_batch=1).awaitTermination()
    want = found(streamed_entries(spark, store, "csv_signal"))
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"))
    for file in (last, last.with_name(f".{last.name}.crc")):  # as if the last batch hadn't been committed
        file.unlink(missing_ok=True)
    compact_types(spark, store)
    stream_entries(spark, str(source), "csv_signal", store, str(tmp_path / "cp"), max_files_per_batch=1).awaitTermination()
    assert found(streamed_entries(spark, store, "csv_signal")) == want

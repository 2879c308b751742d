"""The clustered store: what filters skip, replaced sources, compaction."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sigtrail.schema import ENTRY_SCHEMA
from sigtrail.sinks.store import compact, orphan_sources, read_entries, remove_orphans, stored_sources, write_entries


def entries(spark, n, source="a", signals=64, first=0):
    rows = spark.range(first, first + n).select(
        "id", F.lit(source).alias("source_id"), (F.col("id") * 7919 % 100_003).alias("ts_ms"),
        F.concat(F.lit("d"), F.lpad((F.col("id") * 31 % signals).cast("string"), 3, "0")).alias("device_id"),
        F.lit("s").alias("signal"), F.lit("").alias("category"), F.lit(1).cast("byte").alias("val_type"),
        F.lit(None).cast("boolean").alias("val_bool"), F.col("id").alias("val_int"), F.lit(None).cast("double").alias("val_float"), F.lit(None).cast("string").alias("val_str"),
    )
    return rows.toDF(*ENTRY_SCHEMA.names)


def found(df):
    return sorted(map(str, df.collect()))


def bounds(spark, path):
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("file").agg(F.min("device_id"), F.max("device_id"), F.min("ts_ms"), F.max("ts_ms")).collect()


def test_both_filters_skip_most_files(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = entries(spark, 20_000)
    write_entries(rows, path, rows_per_file=320)
    files = bounds(spark, path + "/entries")
    assert len(files) >= 48
    for device in ("d000", "d031", "d063"):
        assert sum(low <= device <= high for _, low, high, _, _ in files) <= len(files) / 3
    for t in (0, 50_000, 99_000):
        assert sum(low <= t <= high for _, _, _, low, high in files) <= len(files) / 3
    assert found(read_entries(spark, path)) == found(rows)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "s")
    write_entries(entries(spark, 500), path)
    write_entries(entries(spark, 300, "b"), path)
    write_entries(entries(spark, 200, "b"), path)  # so that rows are replaced
    plan = read_entries(spark, path).filter("device_id = 'd001' AND ts_ms > 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(device_id,d001)" in plan and "GreaterThan(ts_ms,5)" in plan


def test_a_source_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    first = entries(spark, 100).unionByName(entries(spark, 50, "b"))
    write_entries(first, path)
    again = entries(spark, 30, "b", first=1000)
    write_entries(again, path)
    assert found(read_entries(spark, path)) == found(entries(spark, 100).unionByName(again))
    assert found(read_entries(spark, path, ["b"])) == found(again)
    write_entries(entries(spark, 0), path)
    assert found(read_entries(spark, path)) == found(entries(spark, 100).unionByName(again))


def test_a_write_that_was_not_committed_is_invisible(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = entries(spark, 40)
    write_entries(rows, path)
    entries(spark, 9, "z").write.parquet(path + "/entries/batch=1")
    assert found(read_entries(spark, path)) == found(rows)
    other = entries(spark, 5, "y")
    write_entries(other, path)
    assert found(read_entries(spark, path)) == found(rows.unionByName(other))


def folders(path, kind="entries"):
    return sorted(p.name for p in Path(path, kind).iterdir() if p.name.startswith("batch="))


def test_many_small_sources_become_few_files(spark, tmp_path):
    path = str(tmp_path / "s")
    many = spark.range(2000).select(F.concat(F.lit("log"), (F.col("id") % 1000).cast("string")).alias("source_id"), "id").join(entries(spark, 2000).drop("source_id"), "id").select(*ENTRY_SCHEMA.names)
    write_entries(many, path)
    assert len(list(Path(path, "entries").rglob("part-*.parquet"))) == 1
    for k in range(3):
        write_entries(entries(spark, 10, f"more{k}"), path)
    want = found(read_entries(spark, path))
    assert len(want) == 2030
    assert compact(spark, path) == 4
    assert len(folders(path)) == 1 and found(read_entries(spark, path)) == want
    assert compact(spark, path) == 0
    assert stored_sources(spark, path).count() == 1003


def test_compaction_drops_replaced_and_removed_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    write_entries(entries(spark, 50).unionByName(entries(spark, 60, "b")).unionByName(entries(spark, 5, "c")), path)
    write_entries(entries(spark, 20, "b"), path)
    assert remove_orphans(spark, path, spark.createDataFrame([("a",), ("b",)], "source_id string")) == 1
    want = entries(spark, 50).unionByName(entries(spark, 20, "b"))
    assert found(read_entries(spark, path)) == found(want)
    assert orphan_sources(spark, path, spark.createDataFrame([("a",)], "source_id string")).collect()[0][0] == "b"
    assert compact(spark, path) == 2
    assert found(read_entries(spark, path)) == found(want)
    assert spark.read.parquet(path + "/entries").count() == 70
    assert remove_orphans(spark, path, spark.createDataFrame([], "source_id string")) == 2
    assert read_entries(spark, path).count() == 0 and folders(path) == []
    write_entries(entries(spark, 3, "c"), path)
    assert found(read_entries(spark, path)) == found(entries(spark, 3, "c"))


def test_named_batches_keep_their_latest(spark, tmp_path):
    path = str(tmp_path / "s")
    for k in range(4):
        write_entries(entries(spark, 10 + k, f"f{k}"), path, batch=k)
    want = found(read_entries(spark, path))
    assert compact(spark, path, named=True) == 3
    assert folders(path) == ["batch=-1", "batch=3"] and found(read_entries(spark, path)) == want
    write_entries(entries(spark, 13, "f3"), path, batch=3)  # written again
    write_entries(entries(spark, 1, "f4"), path, batch=4)
    assert read_entries(spark, path).count() == len(want) + 1
    assert compact(spark, path, named=True) == 2
    assert folders(path) == ["batch=-2", "batch=4"] and read_entries(spark, path).count() == len(want) + 1


@pytest.mark.parametrize("bits", [1, 3])
def test_places_on_the_curve(spark, bits):
    from sigtrail.sinks.store import _z_value

    rng = random.Random(bits)
    pairs = [(rng.randrange(1 << bits), rng.randrange(1 << bits)) for _ in range(20)]
    got = spark.createDataFrame(pairs, "x int, y int").select("x", "y", _z_value([F.col("x"), F.col("y")], bits).alias("z")).collect()
    for x, y, z in got:
        assert z == int("".join(f"{x:0{bits}b}"[i] + f"{y:0{bits}b}"[i] for i in range(bits)), 2)

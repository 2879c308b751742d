"""Formats line by line: accepted shapes, typing, rejected lines and line order."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sigtrail.functions.typing import extract_device_id, infer_type, parse_ts_ms
from sigtrail.schema import INGEST_ORDER
from sigtrail.operators.messages import secs_items
from sigtrail.sources import backtick, generic, mcs, plc, secs
from sigtrail.sources.detect import detect_format
from sigtrail.sources.ingest import read_logs


def values(entries):
    out = []
    for r in entries.orderBy(*INGEST_ORDER).collect():
        value = {0: r["val_bool"], 1: r["val_int"], 2: r["val_float"], 3: r["val_str"]}[r["val_type"]]
        out.append((r["device_id"], r["signal"], r["category"], value))
    return out


def reasons(errors):
    return [r["reason"] for r in errors.orderBy("source_id", "line_key").collect()]


def test_plc_debug(spark, lines):
    path = lines(
        "﻿2024-03-07 06:11:05.123 [INFO] [/Hall/Oven3] [Heat:DoorShut] (bool) : TRUE\n"
        "\n"
        "2024-03-07 06:11:06.000 [INFO] [/Hall/Oven3] [Heat:Zone2] (float) : 181.25\r\n"
        "2024-03-07 06:11:07 [DEBUG] [K.M.Rig-7@Q4] [C:Count] (Integer) : 0x1F\n"
        "2024-03-07 06:11:08.5 [DEBUG] [] [Cat : Name ] (string) : 12: [x]\n"
        "2024-03-07 06:11:08.5 [DEBUG] [] [ : Name] (string) : 12\n"
        "not a log line at all\n"
        "2024-99-07 06:11:05.123 [INFO] [/Hall/Oven3] [Heat:DoorShut] (bool) : TRUE\n"
    )
    log = plc.read_plc_debug(spark, path)
    assert values(log.entries) == [
        ("Oven3", "DoorShut", "Heat", True),
        ("Oven3", "Zone2", "Heat", "181.25"),
        ("Rig-7", "Count", "C", 31),
        ("Cat", "Name", "Cat", "12: [x]"),
    ]
    assert [r["ts_ms"] % 100_000 for r in log.entries.orderBy("id").collect()] == [65123, 66000, 67000, 68500]
    assert reasons(log.errors) == [
        "device ID not found in path", "line does not match PLC debug format", "invalid timestamp",
    ]


def test_plc_tab(spark, lines):
    path = lines(
        "2024-05-02 21:40:08.350 [] NORTH/LINE/PUMP-31\tFLOW_RATE\tIN\t870\t\tBAY\tG1\tG2\t2024-05-02 21:40:08.350\n"
        "2024-05-02 21:40:08.350 [] NORTH/LINE/PUMP-31\tFLOW_RATE\tIN\tON\n"
        "2024-05-02 21:40:08.350 [] NORTH/LI NE\tFLOW_RATE\tIN\t1\t\tBAY\tG1\tG2\t2024-05-02 21:40:08.350\n"
        "2024-05-02 21:40:08.350 [] NORTH\n"
    )
    log = plc.read_plc_tab(spark, path)
    # The signal has an integer beyond 0/1, so its boolean becomes a number.
    assert values(log.entries) == [("PUMP-31", "FLOW_RATE", "", 870), ("PUMP-31", "FLOW_RATE", "", 1)]
    assert reasons(log.errors) == ["device ID not found in path", "line does not match PLC tab format"]


def test_csv(spark, lines):
    path = lines(
        "2024-06-30 04:15:59.007,Q7-88@K2,M,415\n"
        "2024-06-30 04:16:00,Q7-88@K2,N, a, b\n"
        "2024-06-30 04:16:00.1,odd name,N,\n"
        "Timestamp,Device\n"
        "when,Device,Signal,1\n"
    )
    log = plc.read_csv_signal(spark, path)
    assert values(log.entries) == [("Q7-88", "M", "", 415), ("Q7-88", "N", "", "a, b"), ("odd name", "N", "", "")]
    assert reasons(log.errors) == ["line does not match CSV signal format", "invalid timestamp"]


def test_mcs(spark, lines):
    path = lines(
        "2024-08-19 17:22:41.012 [UPDATE=JOB77, POD-5] [CarrierLoc=R4-31], [Priority=8], [IsBoost=maybe], [X=None], [Y=]\n"
        "2024-08-19 17:22:42.012 [REMOVE=POD-5] \n"
        "2024-08-19 17:22:42.012 [MOVE=POD-5] [A=1]\n"
    )
    log = mcs.read_mcs(spark, path)
    assert values(log.entries) == [
        ("POD-5", "_Action", "", "UPDATE"),
        ("POD-5", "_CommandID", "", "JOB77"),
        ("POD-5", "CurrentLocation", "", "R4-31"),
        ("POD-5", "Priority", "", 8),
        ("POD-5", "IsBoost", "", False),
        ("POD-5", "_Action", "", "REMOVE"),
    ]
    assert reasons(log.errors) == ["line does not match MCS format"]


def test_observable(spark, lines):
    path = lines(
        "date time status variables device-id datatype tag\n"
        "2024-11-03 09:47:20:118`OBSERVABLE`HOST GET <<< MODE`Z9-14`Short`6`7`1`NOTE=x\n"
        "2024-11-03 09:47:20:118`OBSERVABLE`a >>> b >>> FLAG`Z9-14`Boolean`True``1`t\n"
        "2024-11-03 09:47:20:118`OBSERVABLE`plain WORD`Z9-14`odd`x`0b101`1`t\n"
        "2024-11-03 09:47:20:118`OTHER`v`Z9-14`odd`x`1`1`t\n"
        "2024-11-03 09:47:20:118`OBSERVABLE` `Z9-14`odd`x`1`1`t\n"
        "2024-11-03 09:47:20:118`OBSERVABLE`v` `odd`x`1`1`t\n"
        "2024-13-03 09:47:20:118`OBSERVABLE`v`d`odd`x`1`1`t\n"
        "too`few\n"
    )
    log = backtick.read_observable(spark, path)
    assert values(log.entries) == [("Z9-14", "MODE", "", 7), ("Z9-14", "FLAG", "", True), ("Z9-14", "WORD", "", 5)]
    assert reasons(log.errors) == [
        "invalid observable status", "missing variable field", "missing device-id",
        "invalid timestamp", "line does not match observable format",
    ]


def test_trs(spark, lines):
    row = "2024-10-12 13:33:07:902`TRS`HUB`41178`COMPLETED`20`TT15`TT15`V2-610`{dest}`XR9`7`381206`{at}`OK`a`b"
    path = lines("\n".join([row.format(dest="SN0", at="381206"), row.format(dest="D", at=""), "a`b"]) + "\n")
    log = backtick.read_trs(spark, path)
    assert [v[3] for v in values(log.entries)] == [
        "41178|COMPLETED|V2-610|381206|381206|OK", "41178|COMPLETED|V2-610|D|XR9|OK",
    ]
    assert log.errors.count() == 0


def test_generic(spark, lines):
    path = lines("2024-04-25 15:05:10.123 [WARN] low\nstack line\n2024-04-25 15:05:11 plain text\n2024-19-25 15:05:11 x\n")
    log = generic.read_generic(spark, path)
    assert values(log.entries) == [("system", "WARN", "", "low"), ("system", "INFO", "", "plain text")]
    assert reasons(log.errors) == ["invalid timestamp"]


SECS = """@2024/07/16 22:51:07.255^INFO^SECS_II^SEND
TransactionTime : 2024/07/16 22:51:07.255 S6F11 W, S6F11 - Event Report - CEID 744. Gate [SystemByte = 50617]
 <L,3 [L0]
   <U2,1 0 [LoadID]>
   <A,9 ask "why" [Text]>
   <L,0>
 >.
trailing noise
@2024/07/16 22:51:07.301^INFO^SECS_II^RECV
TransactionTime : 2024/07/16 22:51:07.301 S6F12, S6F12 - Ack [SystemByte = 50617]
 <B,1 0>.
@2024/07/16 22:51:08.000^INFO^SECS_II^RECV
TransactionTime : 2024/07/16 22:51:08.000 S6F999 - Bad function
 <B,1 0>.
@2024/07/16 22:51:09.000^INFO^SECS_II^RECV
TransactionTime : 2024/07/16 22:51:09.000 S1F1 - Short list
 <L,2
   <B,1 0>
 >.
@2024/07/16 22:51:10.000^INFO^SECS_II^RECV
no transaction
"""


@pytest.mark.parametrize("breaks", ["\n", "\r\n"])
def test_secs(spark, lines, tmp_path, breaks):
    path = tmp_path / "secs.log"
    path.write_bytes(SECS.replace("\n", breaks).encode())
    log = secs.read_secs(spark, str(path))
    first, second = log.entries.orderBy("id").collect()
    assert (first["category"], second["category"]) == ("SEND", "RECV")
    packed = json.loads(first["val_str"])
    assert (packed["systemByte"], packed["ceid"], packed["waitBit"]) == (50617, 744, True)
    assert packed["body"]["items"] == [
        {"type": "U2", "count": 1, "value": "0", "name": "LoadID"},
        {"type": "A", "count": 9, "value": 'ask "why"', "name": "Text"},
        {"type": "L", "count": 0},
    ]
    assert json.loads(second["val_str"])["body"] == {"type": "B", "count": 1, "value": "0"}
    assert sorted(reasons(log.errors)) == [
        "SML body parse error", "invalid stream/function code", "malformed TransactionTime line",
    ]
    classified = secs.classify_secs(secs.read_secs_records(spark, str(path)))
    items = secs_items(secs.secs_messages(classified)).orderBy("id", "seq").collect()
    assert [(i["seq"], i["depth"], i["type"]) for i in items] == [(0, 0, "L"), (1, 1, "U2"), (2, 1, "A"), (3, 1, "L"), (0, 0, "B")]


def test_detection_and_mixed_reading(spark, lines):
    tab = lines("2024-05-02 21:40:08.350 [] P/DEV\tS\tIN\t12\t\tL\tF\tF\t2024-05-02 21:40:08.350\n" * 3, "a.log")
    trs = lines("2024-10-12 13:33:07:902`TRS`H`6`DONE`5`B`B`S`D`C`1`2`3`OK\n" * 3, "b.log")
    message = lines(SECS, "c.log")
    blank = lines("\n\n\n2024-04-25 15:05:10 [WARN] low\nmore\n", "d.log")
    odd = lines("nothing known\n", "e.log")
    found = detect_format(spark, [tab, trs, message, blank, odd]).collect()
    named = {r["source_id"][-5:]: r["format"] for r in found}
    assert named == {"a.log": "plc_tab", "b.log": "trs_log", "c.log": "secs_log", "d.log": "generic_log", "e.log": None}
    log = read_logs(spark, [tab, message])
    assert (log.parser_name, log.entries.count(), log.errors.count()) == ("merged", 5, 3)
    assert read_logs(spark, [trs]).parser_name == "trs_log"
    with pytest.raises(ValueError):
        read_logs(spark, [odd])


def test_line_order_over_many_splits(spark, lines):
    count = 4000
    path = lines("".join(f"2024-04-25 15:05:10 [L] row {i}\n" for i in range(count)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        entries = generic.read_generic(spark, path).entries
        assert entries.rdd.getNumPartitions() > 10
        rows = entries.orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["val_str"] for r in rows] == [f"row {i}" for i in range(count)]


def test_scalars(spark):
    kinds = {"TRUE": "boolean", "yes": "boolean", "1": "integer", "0": "integer", "-100": "integer", "1_000,0": "integer",
             "0xFf": "integer", "0x": "string", "3.14": "string", "hello": "string", "": "string", " on ": "boolean"}
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", infer_type(F.col("t")).alias("k")).collect()} == kinds
    stamps = {"1970-01-01 00:00:01": 1000, "1970-01-01 00:00:00.5": 500, "1970-01-01 00:00:00.1239999": 123,
              "1970-01-01 24:00:00": None, "1970-02-30 00:00:00": 60 * 86_400_000, "1970-01-01": None, "1969-12-31 23:59:59.999": -1}
    df = spark.createDataFrame([(k,) for k in stamps], "t string")
    assert {r["t"]: r["m"] for r in df.select("t", parse_ts_ms(F.col("t")).alias("m")).collect()} == stamps
    paths = {"a/b.C-1@X": "C-1", "C_1": "C_1", "a]b": "b", "a b": "", "a/": "", "a@b.c": "c"}
    df = spark.createDataFrame([(k,) for k in paths], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", extract_device_id(F.col("t")).alias("d")).collect()} == paths

"""Events as SECS messages: written as log text, read back and analysed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks.ingest import _say, _text, plain, write_lines
from checks.registry import EV, check
from sigtrail.adapters import events
from sigtrail.operators import messages
from sigtrail.sources import secs


def message() -> Column:
    at = F.date_format(F.timestamp_millis("ts_ms"), "yyyy/MM/dd HH:mm:ss.SSS")
    sends = F.col("k") >= 50
    user = F.substring("device_id", 2, 10)
    wait = F.when(sends, " W,").otherwise("")
    head = _say(
        "@", at, "^INFO^SECS_II^", F.when(sends, "SEND").otherwise("RECV"), "\nTransactionTime : ", at, " S6F",
        F.when(sends, "11").otherwise("12"), wait, " S6 - Event Report - CEID ", _text("id"), ". \"Port\" ",
        F.col("signal"), F.when(F.col("signal") == "error", "").otherwise(_say(" [SystemByte = ", user, "]")), "\n",
    )
    whole = _say(
        " <L,3 [L0]\n   <U2,1 ", _text("k"), " [DataID]>\n   <L,2\n     <A,4 ", F.col("device_id"), " [Unit ID]>\n     <L,0>\n   >\n",
        "   <BOOLEAN,1 1>\n >.",
    )
    short = F.lit(" <L,1 [L0]\n   <U2,1 5>\n   <U2,1 6>\n >.")
    return F.concat(head, F.when(F.col("k") >= 95, short).otherwise(whole))


def written(spark, sf):
    path = write_lines(events(spark, sf).select(message().alias("value")), "secs")
    return secs.read_secs_records(spark, path)


def read(spark, sf):
    return secs.secs_messages(secs.classify_secs(written(spark, sf)))


MSG = (
    EV
    + """, msg AS (SELECT id, ts_ms, CASE WHEN k >= 50 THEN 'SEND' ELSE 'RECV' END AS direction, 6 AS stream, CASE WHEN k >= 50 THEN 11 ELSE 12 END AS function,
  'S6F' || CASE WHEN k >= 50 THEN 11 ELSE 12 END AS stream_function, k >= 50 AS wait_bit, CASE WHEN signal = 'error' THEN 0 ELSE CAST(substr(device_id, 2) AS BIGINT) END AS system_byte,
  CAST(id AS INTEGER) AS ceid, 'Event Report - CEID ' || id || '. "Port" ' || signal AS message_desc, k, device_id FROM ev WHERE k < 95)"""
)


@check(f"WITH {MSG} SELECT ts_ms, direction, stream, function, stream_function, wait_bit, system_byte, ceid, message_desc FROM msg")
def secs_messages(spark, sf):
    return read(spark, sf).select(
        "ts_ms", "direction", "stream", "function", "stream_function", "wait_bit", "system_byte", "ceid", "message_desc"
    )


@check(f"WITH {EV} SELECT 'SML body parse error' AS reason, count(*) AS n FROM ev WHERE k >= 95")
def secs_errors(spark, sf):
    return secs.parse_secs(written(spark, sf)).errors.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@check(f"""WITH {MSG}, i AS (
  SELECT ts_ms, ceid, 0 AS seq, 0 AS depth, 'L' AS type, 3 AS count, '' AS value, 'L0' AS name FROM msg
  UNION ALL SELECT ts_ms, ceid, 1, 1, 'U2', 1, CAST(k AS VARCHAR), 'DataID' FROM msg
  UNION ALL SELECT ts_ms, ceid, 2, 1, 'L', 2, '', '' FROM msg
  UNION ALL SELECT ts_ms, ceid, 3, 2, 'A', 4, device_id, 'Unit ID' FROM msg
  UNION ALL SELECT ts_ms, ceid, 4, 2, 'L', 0, '', '' FROM msg
  UNION ALL SELECT ts_ms, ceid, 5, 1, 'BOOLEAN', 1, '1', '' FROM msg)
SELECT * FROM i""")
def secs_items(spark, sf):
    items = messages.secs_items(read(spark, sf), beside=("ts_ms", "ceid"))
    return items.select("ts_ms", "ceid", "seq", "depth", "type", "count", "value", "name")


@check(f"""WITH {MSG} SELECT ts_ms, 'SECS' AS device_id, 'SECS' AS signal, direction AS category, 3 AS val_type, CAST(NULL AS BOOLEAN) AS val_bool, CAST(NULL AS BIGINT) AS val_int,
  '{{"timestamp":"' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || '","level":"INFO","category":"SECS_II","direction":"' || direction || '","stream":6,"function":' || function ||
  ',"streamFunction":"' || stream_function || '","waitBit":' || CASE WHEN wait_bit THEN 'true' ELSE 'false' END || ',"systemByte":' || system_byte || CASE WHEN ceid <> 0 THEN ',"ceid":' || ceid ELSE '' END ||
  ',"messageDesc":"' || replace(message_desc, '"', '\\"') || '","body":{{"type":"L","count":3,"name":"L0","items":[{{"type":"U2","count":1,"value":"' || k || '","name":"DataID"}},' ||
  '{{"type":"L","count":2,"items":[{{"type":"A","count":4,"value":"' || device_id || '","name":"Unit ID"}},{{"type":"L","count":0}}]}},{{"type":"BOOLEAN","count":1,"value":"1"}}]}}}}' AS val_str FROM msg""")
def ingest_secs(spark, sf):
    return plain(secs.parse_secs(written(spark, sf)).entries)


@check(f"WITH {MSG} SELECT direction, stream_function, CAST(system_byte AS VARCHAR) AS system_byte, message_desc AS message_body FROM msg")
def secs_fields(spark, sf):
    return messages.secs_fields(secs.parse_secs(written(spark, sf)).entries).drop("source_id", "id")


@check(f"WITH {MSG} SELECT ts_ms, direction AS lane FROM msg")
def secs_lanes(spark, sf):
    return messages.secs_lanes(secs.parse_secs(written(spark, sf)).entries).select("ts_ms", "lane")


@check(f"""WITH {MSG}, r AS (SELECT s.ceid AS send, s.system_byte, s.ts_ms AS send_ms, r.ts_ms AS recv_ms, row_number() OVER (PARTITION BY s.id ORDER BY r.ts_ms, r.id) AS n
  FROM msg s LEFT JOIN msg r ON r.system_byte = s.system_byte AND r.direction = 'RECV' AND (r.ts_ms, r.id) > (s.ts_ms, s.id) WHERE s.direction = 'SEND')
SELECT system_byte, send_ms, recv_ms, recv_ms - send_ms AS latency_ms FROM r WHERE n = 1""")
def secs_transactions(spark, sf):
    # One equipment whose log is spread over several files.
    return messages.secs_transactions(read(spark, sf), by=()).select("system_byte", "send_ms", "recv_ms", "latency_ms")


@check(f"""WITH {MSG}, r AS (SELECT s.ceid % 3 AS tool, s.ceid AS send, s.system_byte, s.ts_ms AS send_ms, r.ts_ms AS recv_ms, row_number() OVER (PARTITION BY s.id ORDER BY r.ts_ms, r.id) AS n
  FROM msg s LEFT JOIN msg r ON r.system_byte = s.system_byte AND r.ceid % 3 = s.ceid % 3 AND r.direction = 'RECV' AND (r.ts_ms, r.id) > (s.ts_ms, s.id) WHERE s.direction = 'SEND')
SELECT tool, system_byte, send_ms, recv_ms, recv_ms - send_ms AS latency_ms FROM r WHERE n = 1""")
def secs_transactions_by_tool(spark, sf):
    """Merged logs of three tools, whose system bytes overlap."""
    merged = read(spark, sf).withColumn("tool", F.col("ceid") % 3)
    return messages.secs_transactions(merged, by=("tool",)).select("tool", "system_byte", "send_ms", "recv_ms", "latency_ms")

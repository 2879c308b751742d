"""Round trips: events are written as log text, read back and compared with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.merge import _sources, overlapping
from checks.registry import EV, check
from sigtrail.adapters import events, int_entries, table
from sigtrail.functions.typing import infer_type, parse_ts_ms, with_value
from sigtrail.session import scratch_path
from sigtrail.sources import backtick, generic, mcs, plc, stocker
from sigtrail.sources.detect import detect_format
from sigtrail.sources.ingest import read_logs, session_summary


def stamp(fraction_mark: str = ".") -> Column:
    return F.date_format(F.timestamp_millis("ts_ms"), f"yyyy-MM-dd HH:mm:ss'{fraction_mark}'SSS")


def write_lines(lines: DataFrame, label: str) -> str:
    path = scratch_path(lines.sparkSession, label)
    lines.write.text(path)
    return path


def rendered(spark: SparkSession, sf: str, line, label: str, together: str | None = None) -> str:
    """Events as text; rows that agree in ``together`` go to one file, whose types are
    settled together."""
    rows = events(spark, sf)
    rows = rows.repartition(together) if together else rows
    return write_lines(rows.select(line().alias("value")), label)


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(name: str) -> Column:
    return F.col(name).cast("string")


STAMP = "strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g')"


# --- PLC debug --------------------------------------------------------------

def plc_debug_line() -> Column:
    kind, k = F.col("signal"), F.col("k")
    good = lambda path, dtype, value: _say(
        stamp(), " [INFO] [", path, "] [ ", F.col("category"), " :", kind, "] (", dtype, ") : ", value, " "
    )
    place = _say("Plant/Line 1.", F.col("device_id"), "@D1")
    return (
        F.when(k >= 98, _say("no log line ", _text("id")))
        .when(k >= 96, _say("2024-13-", F.substring(stamp(), 9, 15), " [I] [A/B] [C:D] (string) : late"))
        .when(kind == "view", good(place, "integer", (k + 2).cast("string")))
        .when(kind == "click", good(place, "BOOL", F.when(k >= 50, "On").otherwise("FALSE")))
        .when(kind == "purchase", good(place, "float", _say(_text("k"), ".5")))
        .when(kind == "signup", good("Plant/Line one/", "string", _text("k")))
        .otherwise(good(place, "String", _say("jam: [", _text("k"), "] (x)")))
    )





def plain(entries: DataFrame) -> DataFrame:
    return entries.select(
        "ts_ms", "device_id", "signal", "category",
        F.col("val_type").cast("int").alias("val_type"), "val_bool", "val_int", "val_str",
    )


_DEBUG_SQL = f"""WITH {EV} SELECT ts_ms, CASE WHEN signal = 'signup' THEN category ELSE device_id END AS device_id, signal, category,
  CASE signal WHEN 'view' THEN 1 WHEN 'click' THEN 0 ELSE 3 END AS val_type,
  CASE WHEN signal = 'click' THEN k >= 50 END AS val_bool, CASE WHEN signal = 'view' THEN k + 2 END AS val_int,
  CASE signal WHEN 'purchase' THEN k || '.5' WHEN 'signup' THEN CAST(k AS VARCHAR) WHEN 'error' THEN 'jam: [' || k || '] (x)' END AS val_str
FROM ev WHERE k < 96"""


@check(_DEBUG_SQL)
def ingest_plc_debug(spark, sf):
    return plain(plc.read_plc_debug(spark, rendered(spark, sf, plc_debug_line, "plc")).entries)


@check(f"""WITH {EV} SELECT CASE WHEN k >= 98 THEN 'no log line ' || id ELSE '2024-13-' || substr({STAMP}, 9, 15) || ' [I] [A/B] [C:D] (string) : late' END AS content,
  CASE WHEN k >= 98 THEN 'line does not match PLC debug format' ELSE 'invalid timestamp' END AS reason FROM ev WHERE k >= 96""")
def ingest_errors(spark, sf):
    return plc.read_plc_debug(spark, rendered(spark, sf, plc_debug_line, "plc")).errors.select("content", "reason")


# --- PLC tab, CSV -------------------------------------------------------------

def plc_tab_line(value: Column | None = None) -> Column:
    number = (F.col("k") + 2).cast("string")
    return _say(
        stamp(), " [] Plant/", F.col("device_id"), "@X\t ", F.col("signal"), "\tIN\t",
        number if value is None else F.coalesce(value, number),
        "\t\tLOC\tF1\tF2\t", stamp(),
    )


def plc_tab_switches() -> Column:
    return plc_tab_line(F.when(F.col("k") % 7 == 0, "ON"))


# A signal with a number beyond 0 and 1 has its booleans read as numbers.
@check(f"""WITH {EV}, t AS (SELECT *, bool_or(k % 7 <> 0) OVER (PARTITION BY device_id, signal) AS whole FROM ev)
SELECT ts_ms, device_id, signal, '' AS category, CASE WHEN whole THEN 1 ELSE 0 END AS val_type, CASE WHEN NOT whole THEN true END AS val_bool,
  CASE WHEN whole THEN CASE WHEN k % 7 = 0 THEN 1 ELSE k + 2 END END AS val_int, CAST(NULL AS VARCHAR) AS val_str FROM t""")
def ingest_plc_tab(spark, sf):
    return plain(plc.read_plc_tab(spark, rendered(spark, sf, plc_tab_switches, "tab", together="device_id")).entries)


def csv_line() -> Column:
    kind = F.col("signal")
    value = (
        F.when(kind == "view", _say("0x", F.lower(F.hex("k"))))
        .when(kind == "click", F.when(F.col("k") >= 50, "yes").otherwise("NO"))
        .otherwise(_say("part ", _text("k"), ", of, ", _text("id")))
    )
    return _say(stamp(), " , ", F.col("device_id"), ",", kind, ", ", value, " ")


@check(f"""WITH {EV} SELECT ts_ms, device_id, signal, '' AS category, CASE signal WHEN 'view' THEN 1 WHEN 'click' THEN 0 ELSE 3 END AS val_type,
  CASE WHEN signal = 'click' THEN k >= 50 END AS val_bool, CASE WHEN signal = 'view' THEN k END AS val_int,
  CASE WHEN signal NOT IN ('view', 'click') THEN 'part ' || k || ', of, ' || id END AS val_str FROM ev""")
def ingest_csv(spark, sf):
    return plain(plc.read_csv_signal(spark, rendered(spark, sf, csv_line, "csv", together="device_id")).entries)


# --- key/value, observable, transfer, plain -------------------------------------

def mcs_line() -> Column:
    two = F.col("k") >= 20
    ids = F.when(two, _say("CMD", _text("id"), ", ", F.col("device_id"))).otherwise(F.col("device_id"))
    return _say(
        stamp(), " [UPDATE=", ids, "] [CarrierLoc=UNIT", _text("k"), "], [Priority=", _text("k"),
        "], [IsBoost=", F.when(F.col("k") >= 50, "1").otherwise("none"), "], [Note=None], [ResultCode=", _text("k"), "], [Flag=true], [Free=]",
    )


@check(f"""WITH {EV}, s AS (
  SELECT *, '_Action' AS name, 3 AS val_type, NULL AS b, NULL AS i, 'UPDATE' AS t FROM ev
  UNION ALL SELECT *, '_CommandID', 3, NULL, NULL, 'CMD' || id FROM ev WHERE k >= 20
  UNION ALL SELECT *, 'CurrentLocation', 3, NULL, NULL, 'UNIT' || k FROM ev
  UNION ALL SELECT *, 'Priority', 1, NULL, k, NULL FROM ev
  UNION ALL SELECT *, 'IsBoost', 0, k >= 50, NULL, NULL FROM ev
  UNION ALL SELECT *, 'ResultCode', 3, NULL, NULL, CAST(k AS VARCHAR) FROM ev
  UNION ALL SELECT *, 'Flag', 0, true, NULL, NULL FROM ev)
SELECT ts_ms, device_id, name AS signal, '' AS category, val_type, b AS val_bool, i AS val_int, t AS val_str FROM s""")
def ingest_mcs(spark, sf):
    return plain(mcs.read_mcs(spark, rendered(spark, sf, mcs_line, "mcs")).entries)


def observable_line() -> Column:
    kind = F.col("signal")
    variable = F.when(kind == "view", _say("CIM >>> ", kind)).when(kind == "click", _say("CIM READ <<< a <<< ", kind)).otherwise(_say("last word ", kind))
    dtype = F.when(kind == "view", "Short").when(kind == "click", "BOOL").otherwise("other")
    new = F.when(kind == "click", F.when(F.col("k") >= 50, "True").otherwise("False")).when(kind == "error", "").otherwise(_text("k"))
    return _say(stamp(":"), "`OBSERVABLE`", variable, "`", F.col("device_id"), "`", dtype, "`7`", new, "`1`TAG")


@check(f"""WITH {EV} SELECT ts_ms, device_id, signal, '' AS category, CASE WHEN signal = 'click' THEN 0 ELSE 1 END AS val_type,
  CASE WHEN signal = 'click' THEN k >= 50 END AS val_bool, CASE signal WHEN 'click' THEN NULL WHEN 'error' THEN 7 ELSE k END AS val_int, CAST(NULL AS VARCHAR) AS val_str FROM ev""")
def ingest_observable(spark, sf):
    return plain(backtick.read_observable(spark, rendered(spark, sf, observable_line, "observable")).entries)


def trs_line() -> Column:
    rack = F.lpad(F.col("k").cast("string"), 6, "2")
    source = F.when(F.col("k") >= 50, "SN0").otherwise(_say("P", _text("k")))
    current = F.when(F.col("k") >= 70, "").otherwise(_say("L", _text("k")))
    fields = [
        stamp(":"), F.lit("TRS"), F.lit("HST"), _text("id"), F.lit("COMPLETED"), F.lit("50"), F.col("device_id"), F.col("device_id"),
        source, F.lit(" D1 "), F.lit("CRANE"), F.lit("12"), rack, current, F.lit("TR_SUCCESS"), F.lit("x"), F.lit("y"),
    ]
    return F.concat_ws("`", *fields)


@check(f"""WITH {EV} SELECT ts_ms, device_id, 'Transfer' AS signal, '' AS category, 3 AS val_type, CAST(NULL AS BOOLEAN) AS val_bool, CAST(NULL AS BIGINT) AS val_int,
  id || '|COMPLETED|' || CASE WHEN k >= 50 THEN lpad(CAST(k AS VARCHAR), 6, '2') ELSE 'P' || k END || '|D1|' || CASE WHEN k >= 70 THEN 'CRANE' ELSE 'L' || k END || '|TR_SUCCESS' AS val_str FROM ev""")
def ingest_trs(spark, sf):
    return plain(backtick.read_trs(spark, rendered(spark, sf, trs_line, "trs")).entries)


def generic_line() -> Column:
    kind = F.col("signal")
    level = F.when(kind == "error", "[ERROR] ").when(kind == "view", "[DEBUG] ").otherwise("")
    return F.when(F.col("k") >= 95, "continued text").otherwise(_say(stamp(), " ", level, kind, " by ", F.col("device_id")))


_GENERIC = """SELECT ts_ms, 'system' AS device_id, CASE signal WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS signal, '' AS category, 3 AS val_type,
  CAST(NULL AS BOOLEAN) AS val_bool, CAST(NULL AS BIGINT) AS val_int, signal || ' by ' || device_id AS val_str FROM ev WHERE k < 95"""


@check(f"WITH {EV} {_GENERIC}")
def ingest_generic(spark, sf):
    return plain(generic.read_generic(spark, rendered(spark, sf, generic_line, "generic")).entries)


# --- tables ---------------------------------------------------------------------

@check(f"""WITH {EV} SELECT ts_ms, device_id, signal, '' AS category, CASE signal WHEN 'view' THEN 1 WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 3 END AS val_type,
  CASE WHEN signal = 'click' THEN k >= 50 END AS val_bool, CASE WHEN signal IN ('view', 'error') THEN k + 2 END AS val_int,
  CASE WHEN signal IN ('signup', 'purchase') THEN 'S ' || k END AS val_str FROM ev""")
def stocker_observables(spark, sf):
    kind, k = F.col("signal"), F.col("k")
    value = (
        F.when(kind == "click", F.when(k >= 50, ": TRUE").otherwise(":no"))
        .when(kind.isin("view", "error"), _say(": ", (k + 2).cast("string")))
        .otherwise(_say("S ", _text("k")))
    )
    declared = F.when(kind == "view", "Long").when(kind == "click", "Boolean").when(kind == "error", "String").otherwise("")
    rows = events(spark, sf).select(
        "id", stamp().alias("DateTime"), F.col("device_id").alias("SubSystemID"), kind.alias("ObservableID"),
        value.alias("CurrentValue"), declared.alias("ValueType"),
    )
    return plain(stocker.normalize_stk_plc(rows, "id").entries)


@check("""WITH t AS (SELECT epoch_us(l_shipdate) // 1000 AS ts_ms, 'C' || l_orderkey AS device_id, l_linenumber || '|' || l_linestatus || '|' ||
  CASE WHEN l_returnflag = 'A' THEN '1' || lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') ELSE 'S' || l_suppkey END || '|D' || l_suppkey || '|CRANE' || l_linenumber || '|' || l_returnflag AS val_str FROM lineitem)
SELECT *, count(*) AS n FROM t GROUP BY ALL""")
def stocker_transfers(spark, sf):
    key = lambda c: F.col(c).cast("string")
    rack = _say("1", F.lpad((F.col("l_partkey") % 100000).cast("string"), 5, "0"))
    cells = {
        "time": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), "command": key("l_linenumber"), "state": F.col("l_linestatus"),
        "carrier": _say("C", key("l_orderkey")), "source": F.when(F.col("l_returnflag") == "A", "SN0").otherwise(_say("S", key("l_suppkey"))),
        "dest": _say("D", key("l_suppkey")), "crane": _say("CRANE", key("l_linenumber")), "plc_from": F.lit("-"), "plc_to": rack,
        "location": F.lit(" "), "result": F.col("l_returnflag"),
    }
    at = {i: n for n, i in stocker.TRANSFER_COLUMNS.items()}
    columns = [at.get(i, f"unused{i}") for i in range(15)]
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), *[cells.get(c, F.lit("")).alias(c) for c in columns]
    )
    parsed = stocker.normalize_stk_transfer(rows, "id", columns).entries
    return parsed.groupBy("ts_ms", "device_id", "val_str").agg(F.count(F.lit(1)).alias("n"))


# --- detection, mixed formats, summary --------------------------------------------

FORMATS = {
    "plc_debug": plc_debug_line, "plc_tab": plc_tab_line, "mcs_log": mcs_line, "observable_log": observable_line,
    "csv_signal": csv_line, "generic_log": generic_line, "trs_log": trs_line,
}


@check("SELECT * FROM (VALUES ('plc_debug'), ('plc_tab'), ('mcs_log'), ('observable_log'), ('csv_signal'), ('generic_log'), ('trs_log')) f(format), (SELECT count(*) AS lines FROM events)")
def detect_formats(spark, sf):
    """Every format is recognised in the files it was written to."""
    paths = [rendered(spark, sf, line, f"detect_{name}") for name, line in FORMATS.items()]
    found = detect_format(spark, paths)
    label = F.regexp_extract("source_id", r"detect_(\w+)-", 1)
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("source_id"))
    counted = lines.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    right = found.join(counted, "source_id").filter(F.col("format") == label)
    return right.groupBy("format").agg(F.sum("n").alias("lines"))


@check(f"""WITH {EV} SELECT ts_ms, device_id, signal, '' AS category, 1 AS val_type, CAST(NULL AS BOOLEAN) AS val_bool, k + 2 AS val_int, CAST(NULL AS VARCHAR) AS val_str FROM ev
UNION ALL {_GENERIC}""")
def read_mixed_logs(spark, sf):
    paths = [rendered(spark, sf, plc_tab_line, "mixed"), rendered(spark, sf, generic_line, "mixed")]
    return plain(read_logs(spark, paths).entries)


@check(f"""WITH {_sources('k', 'signal')} SELECT source_id, count(*) AS entry_count, count(DISTINCT (device_id, signal)) AS signal_count, count(DISTINCT device_id) AS device_count,
  min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, CAST(0 AS BIGINT) AS error_count, 'merged' AS parser_name FROM m GROUP BY 1""")
def source_summary(spark, sf):
    return session_summary(overlapping(spark, sf, int_entries), parser_name="merged")


# --- scalar readers -----------------------------------------------------------------

@check(f"""WITH {EV} SELECT id, CASE signal WHEN 'view' THEN ts_ms WHEN 'click' THEN ts_ms // 1000 * 1000 WHEN 'purchase' THEN ts_ms - ts_ms % 86400000 - 1704067200000 + 0 * k - (ts_ms // 86400000 * 86400000 - 1704067200000) + 1709251200000 + ts_ms % 86400000
  WHEN 'signup' THEN ts_ms // 1000 * 1000 + 500 END AS ts_ms FROM ev""")
def parse_timestamps(spark, sf):
    """Long, missing and short fractions, a month that does not exist and 30 February."""
    kind, text = F.col("signal"), stamp()
    raw = (
        F.when(kind == "view", _say(text, "999"))
        .when(kind == "click", F.substring(text, 1, 19))
        .when(kind == "purchase", _say("2024-02-30", F.substring(text, 11, 13)))
        .when(kind == "signup", _say(F.substring(text, 1, 19), ".5"))
        .otherwise(_say("2024-13", F.substring(text, 8, 16)))
    )
    return events(spark, sf).select("id", parse_ts_ms(raw).alias("ts_ms"))


@check(f"""WITH {EV}, p AS (SELECT *, k % 6 AS form FROM ev)
SELECT id, CASE form WHEN 4 THEN 'string' WHEN 1 THEN 'boolean' ELSE 'integer' END AS stype,
  CASE WHEN form = 1 THEN k >= 50 END AS val_bool,
  CASE form WHEN 0 THEN k WHEN 2 THEN -(k * 1000) WHEN 3 THEN k WHEN 5 THEN NULL ELSE NULL END AS val_int,
  CASE form WHEN 4 THEN k || '.25' WHEN 5 THEN '0o' || (k % 8) END AS val_str FROM p""")
def infer_and_parse(spark, sf):
    """Hex, words, separators, binary, decimals and octal text."""
    k = F.col("k")
    form = k % 6
    raw = (
        F.when(form == 0, _say(" 0X", F.hex(k)))
        .when(form == 1, F.when(k >= 50, "yes").otherwise("Off"))
        .when(form == 2, _say("-", _text("k"), "_0,00"))
        .when(form == 3, _say("0b", F.bin(k)))
        .when(form == 4, _say(_text("k"), ".25 "))
        .otherwise(_say("0o", (k % 8).cast("string")))
    )
    rows = events(spark, sf).select("id", raw.alias("raw")).withColumn("stype", infer_type(F.col("raw")))
    rows = with_value(rows, "raw", F.col("stype"))
    return rows.select("id", "stype", "value.val_bool", "value.val_int", "value.val_str")

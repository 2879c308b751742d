"""The given tables seen as entries, transfers, carriers and rules.

Every adapter covers its whole table; only the shape changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.functions.transfer import pack_transfer
from sigtrail.functions.typing import tagged
from sigtrail.plans.stages import bind
from sigtrail.schema import COLOR_RULE_SCHEMA, ENTRY_COLUMNS, MAPPING_SCHEMA, VALUE_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Table times carry no zone; they are UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with millisecond time, device name and the number held in ``props``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("device_id"),
        F.col("event_type").alias("signal"),
        F.upper(F.substring("event_type", 1, 1)).alias("category"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def as_entries(df: DataFrame, value: Column, source: str = "events") -> DataFrame:
    rows = bind(df.withColumn("source_id", F.lit(source)), _v=value)
    return rows.select(
        *[F.col(f"_v.{c}").alias(c) if c in VALUE_COLUMNS else F.col(c) for c in ENTRY_COLUMNS]
    )


def int_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_entries(events(spark, sf_dir), tagged(integer=F.col("k")))


def float_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_entries(events(spark, sf_dir), tagged(number=F.col("value")))


def bool_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_entries(events(spark, sf_dir), tagged(boolean=F.col("k") >= 50))


def state_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``State`` signal per device whose text is the event type."""
    rows = events(spark, sf_dir).withColumn("_type", F.col("signal")).withColumn("signal", F.lit("State"))
    return as_entries(rows, tagged(string=F.col("_type")))


def mixed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click is boolean, view integer, purchase decimal, signup and error text."""
    kind, k = F.col("signal"), F.col("k")
    text = F.when(kind == "signup", F.concat(F.lit("level "), k.cast("string"))).when(
        kind == "error", F.concat(F.lit("Failed with "), k.cast("string"))
    )
    value = tagged(
        boolean=F.when(kind == "click", k >= 50),
        integer=F.when(kind == "view", k),
        number=F.when(kind == "purchase", F.col("value")),
        string=text,
    )
    return as_entries(events(spark, sf_dir), value)


def rule_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers, but view is boolean, so that it can be empty."""
    view = F.col("signal") == "view"
    value = tagged(
        boolean=F.when(view, F.col("k") >= 50), integer=F.when(~view, F.col("k"))
    )
    return as_entries(events(spark, sf_dir), value)


def transition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules per user, one of them with overlapping start and end conditions."""
    users = events(spark, sf_dir).select("device_id").distinct()
    none = F.lit(None)
    rule = lambda prefix, kind, s, sc, sv, e, ec, ev, target, tol: F.struct(
        F.concat(F.lit(prefix), F.col("device_id")).alias("rule_id"),
        F.lit(kind).alias("type"),
        F.col("device_id").alias("start_device"),
        F.lit(s).alias("start_signal"),
        F.lit(sc).alias("start_cond"),
        F.lit(sv).cast("string").alias("start_value"),
        (F.col("device_id") if e else none.cast("string")).alias("end_device"),
        F.lit(e).cast("string").alias("end_signal"),
        F.lit(ec).cast("string").alias("end_cond"),
        F.lit(ev).cast("string").alias("end_value"),
        F.lit(target).cast("double").alias("target_ms"),
        F.lit(tol).cast("double").alias("tolerance_ms"),
    )
    rules = F.array(
        rule("order-", "a-to-b", "signup", "not-empty", None, "purchase", "greater", "20", 86400000, 43200000),
        rule("flip-", "a-to-b", "error", "greater", "30", "error", "less", "60", 172800000, None),
        rule("cycle-", "cycle", "click", "greater", "10", None, None, None, 259200000, 86400000),
        rule("fill-", "value-populated", "view", None, None, None, None, None, None, None),
    )
    return users.select(F.inline(rules))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as packed transfer rows between rack positions."""
    rows = table(spark, sf_dir, "lineitem")
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    rack = lambda z, x, y: F.concat(z.cast("string"), digits(x % 1000, 3), digits(y, 2))
    number = F.col("l_linenumber")
    source = rack(1 + F.col("l_suppkey") % 2, F.col("l_partkey"), number)
    dest = rack(1 + F.col("l_partkey") % 2, F.col("l_orderkey"), number)
    packed = pack_transfer(
        [
            number.cast("string"),
            F.when(F.col("l_linestatus") == "O", " completed").otherwise("QUEUED"),
            source,
            F.when(F.col("l_returnflag") == "R", F.lit("PORT-7")).otherwise(dest),
            dest,
            F.col("l_returnflag"),
        ]
    )
    shaped = rows.select(
        (F.col("l_orderkey") * 10 + number).cast("long").alias("id"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
        F.concat(F.lit("C"), F.col("l_orderkey").cast("string")).alias("device_id"),
        F.lit("Transfer").alias("signal"),
        F.lit("").alias("category"),
        packed.alias("_packed"),
    )
    return as_entries(shaped, tagged(string=F.col("_packed")), "lineitem")


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as carriers moving between ten units; sometimes off the map."""
    rows = events(spark, sf_dir)
    k = F.col("k")
    place = F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("UNIT"), (k % 10).cast("string")))
    shaped = rows.select(
        "id", "ts_ms",
        F.regexp_replace("device_id", "^U", "CAR").alias("device_id"),
        F.lit("CurrentLocation").alias("signal"),
        F.lit("").alias("category"),
        place.alias("_place"),
    )
    return as_entries(shaped, tagged(string=F.col("_place")))


def device_mapping(spark: SparkSession) -> DataFrame:
    rows = [(1, "U1", "FIRST"), (2, "U1*2", "WILD"), (3, "U1*", "ONES"), (4, "U7*", "SEVENS"), (5, "U8", "EIGHT")]
    return spark.createDataFrame(rows, MAPPING_SCHEMA)


def color_rules(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "click", "==", "ON", "#00AA00", "", "", 50),
        (2, "view", ">", "80", "", "#AA0000", "HIGH", 100),
        (3, "signup", "!=", "level 5", "#0000AA", "", "L", 50),
        (4, "purchase", "<=", "2.5", "#AAAA00", "", "LOW", 100),
        (5, "idle", "==", "1", "#111111", "", "", 200),
        (6, "error", ">=", "1", "#222222", "", "", 300),
    ]
    return spark.createDataFrame(rows, COLOR_RULE_SCHEMA)

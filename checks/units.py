from __future__ import annotations

from pyspark.sql import functions as F

from checks.asof import DAYS, every_day
from checks.registry import END_MS, EV, MIXED, START_MS, T_MS, check
from sigtrail.adapters import carriers, color_rules, device_mapping, events, mixed_entries, table
from sigtrail.operators import units

# First matching row of the mapping, else the name itself.
MAPPED = """CASE WHEN device_id = 'U1' THEN 'FIRST' WHEN device_id LIKE 'U1%2' THEN 'WILD' WHEN device_id LIKE 'U1%' THEN 'ONES'
  WHEN device_id LIKE 'U7%' THEN 'SEVENS' WHEN device_id = 'U8' THEN 'EIGHT' ELSE device_id END"""

# (priority, ord, color, text) of every rule that matches a value row.
RULE_HITS = """SELECT {at} unit_id, 50 AS priority, 1 AS ord, '#00AA00' AS color, '' AS text FROM v WHERE signal = 'click' AND val_bool
  UNION ALL SELECT {at} unit_id, 100, 2, '#AA0000', 'HIGH' FROM v WHERE signal = 'view' AND val_int > 80
  UNION ALL SELECT {at} unit_id, 50, 3, '#0000AA', 'L' FROM v WHERE signal = 'signup' AND val_str <> 'level 5'
  UNION ALL SELECT {at} unit_id, 100, 4, '#AAAA00', 'LOW' FROM v WHERE signal = 'purchase' AND val_float <= 2.5"""


@check(f"WITH {EV} SELECT DISTINCT device_id, {MAPPED} AS unit_id FROM ev")
def map_devices(spark, sf):
    return units.map_devices(mixed_entries(spark, sf), device_mapping(spark))


@check(f"""WITH {EV}, d AS (SELECT DISTINCT device_id FROM ev), p AS (SELECT i AS ord, 'U' || i || '*' AS pattern, 'P' || i AS unit_id FROM range(1, 1500) t(i)
  UNION ALL SELECT 5000000000 + i, '*' || i, 'S' || i FROM range(1, 900) t(i) UNION ALL SELECT 0, 'U1', 'ONE')
SELECT device_id, coalesce(arg_min(unit_id, ord), device_id) AS unit_id FROM d LEFT JOIN p ON device_id LIKE replace(pattern, '*', '%') GROUP BY device_id""")
def map_devices_many(spark, sf):
    fronts = spark.range(1, 1500).selectExpr("concat('U', id, '*') AS pattern", "id AS ord", "concat('P', id) AS unit_id")
    ends = spark.range(1, 900).selectExpr("concat('*', id) AS pattern", "5000000000 + id AS ord", "concat('S', id) AS unit_id")
    one = spark.sql("SELECT 'U1' AS pattern, 0L AS ord, 'ONE' AS unit_id")
    return units.map_devices(mixed_entries(spark, sf), fronts.union(ends).union(one))


@check(f"""WITH {EV}, d AS (SELECT DISTINCT 'Bay7.' || device_id || '@' || signal AS device_id FROM ev), p AS (SELECT 6000 - i AS ord, '*' || i || '*' AS pattern, 'P' || i AS unit_id FROM range(1, 2500) t(i)
  UNION ALL SELECT 10000 + i, '*U' || i || '@*l*', 'V' || i FROM range(1, 400) t(i) UNION ALL SELECT 90000, '*c*k*', 'CLICK' UNION ALL SELECT 95000, '*@*', 'REST')
SELECT device_id, arg_min(unit_id, ord) AS unit_id FROM d JOIN p ON device_id LIKE replace(pattern, '*', '%') GROUP BY device_id""")
def map_devices_infix(spark, sf):
    """Patterns open at both ends, some of which every device matches."""
    devices = mixed_entries(spark, sf).select(F.concat(F.lit("Bay7."), "device_id", F.lit("@"), "signal").alias("device_id"))
    inside = spark.range(1, 2500).selectExpr("concat('*', id, '*') AS pattern", "6000 - id AS ord", "concat('P', id) AS unit_id")
    mixed = spark.range(1, 400).selectExpr("concat('*U', id, '@*l*') AS pattern", "10000 + id AS ord", "concat('V', id) AS unit_id")
    short = spark.sql("SELECT '*c*k*' AS pattern, 90000L AS ord, 'CLICK' AS unit_id UNION ALL SELECT '*@*', 95000L, 'REST'")
    return units.map_devices(devices, inside.union(mixed).union(short))


@check("""WITH d AS (SELECT DISTINCT 'Line.B' || user_id || '.N' || user_id || '@' || event_type AS device_id, user_id FROM events)
SELECT device_id, 'N' || user_id AS unit_id FROM d""")
def fallback_units(spark, sf):
    number = F.col("user_id").cast("string")
    name = F.concat(F.lit("Line.B"), number, F.lit(".N"), number, F.lit("@"), F.col("event_type"))
    return units.map_devices(table(spark, sf, "events").select(name.alias("device_id")), device_mapping(spark))


@check(f"""WITH {EV}, t AS (SELECT id, signal, k, CASE signal WHEN 'click' THEN CASE WHEN k >= 50 THEN ' ON' ELSE 'off' END WHEN 'view' THEN CAST(k AS VARCHAR) WHEN 'error' THEN 'TRUE' ELSE 'word' END AS text FROM ev),
o AS (SELECT * FROM (VALUES ('==', '1'), ('!=', 'true'), ('>', '50'), ('>=', '50'), ('<', '50'), ('<=', 'word'), ('~', '1')) r(op, rule_value)),
n AS (SELECT *, CASE WHEN lower(trim(text)) IN ('on', 'true', '1') THEN 'true' WHEN lower(trim(text)) IN ('off', 'false', '0') THEN 'false' ELSE lower(trim(text)) END AS norm,
  CASE WHEN rule_value IN ('1', 'true') THEN 'true' ELSE rule_value END AS rule_norm, TRY_CAST(text AS DOUBLE) AS num, TRY_CAST(rule_value AS DOUBLE) AS rule_num FROM t, o)
SELECT id, op, CASE op WHEN '==' THEN norm = rule_norm WHEN '!=' THEN norm <> rule_norm WHEN '>' THEN coalesce(num > rule_num, false) WHEN '>=' THEN coalesce(num >= rule_num, false)
  WHEN '<' THEN coalesce(num < rule_num, false) WHEN '<=' THEN coalesce(num <= rule_num, false) ELSE false END AS hit FROM n""")
def rule_conditions(spark, sf):
    k, signal = F.col("k"), F.col("signal")
    text = (
        F.when(signal == "click", F.when(k >= 50, " ON").otherwise("off"))
        .when(signal == "view", k.cast("string"))
        .when(signal == "error", "TRUE")
        .otherwise("word")
    )
    rules = [("==", "1"), ("!=", "true"), (">", "50"), (">=", "50"), ("<", "50"), ("<=", "word"), ("~", "1")]
    tests = F.array(*[F.struct(F.lit(o).alias("op"), F.lit(v).alias("rule_value")) for o, v in rules])
    rows = events(spark, sf).select("id", text.alias("text"), F.inline(tests))
    hit = units.rule_matches(F.col("text"), F.col("op"), F.col("rule_value"))
    return rows.select("id", "op", hit.alias("hit"))


@check(f"""WITH {MIXED}, r AS (SELECT *, {MAPPED} AS unit_id, row_number() OVER (PARTITION BY device_id, signal ORDER BY ts_ms DESC, id DESC) AS n FROM mixed WHERE ts_ms <= {T_MS}),
u AS (SELECT *, row_number() OVER (PARTITION BY unit_id, signal ORDER BY device_id DESC) AS pick FROM r WHERE n = 1), v AS (SELECT * FROM u WHERE pick = 1),
hits AS ({RULE_HITS.format(at='')} UNION ALL SELECT unit_id, 300, 6, '#222222', '' FROM v WHERE signal = 'error' AND false),
best AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY priority DESC, ord) AS b FROM hits)
SELECT a.unit_id, coalesce(color, '#D3D3D3') AS color, text FROM (SELECT DISTINCT {MAPPED} AS unit_id FROM mixed) a LEFT JOIN (SELECT * FROM best WHERE b = 1) USING (unit_id)""")
def unit_status(spark, sf):
    return units.unit_status(mixed_entries(spark, sf), T_MS, color_rules(spark), device_mapping(spark))


@check(f"""WITH {MIXED}, {DAYS}, r AS (SELECT t_ms, mixed.*, {MAPPED} AS unit_id, row_number() OVER (PARTITION BY t_ms, device_id, signal ORDER BY ts_ms DESC, id DESC) AS n FROM days JOIN mixed ON ts_ms <= t_ms),
u AS (SELECT *, row_number() OVER (PARTITION BY t_ms, unit_id, signal ORDER BY device_id DESC) AS pick FROM r WHERE n = 1), v AS (SELECT * FROM u WHERE pick = 1),
hits AS ({RULE_HITS.format(at='t_ms,')}), best AS (SELECT *, row_number() OVER (PARTITION BY t_ms, unit_id ORDER BY priority DESC, ord) AS b FROM hits)
SELECT t_ms, unit_id, color, text FROM best WHERE b = 1""")
def unit_status_playback(spark, sf):
    return units.unit_status_at(mixed_entries(spark, sf), every_day(spark, sf), color_rules(spark), device_mapping(spark))


@check(f"""WITH {MIXED}, days AS (SELECT 1704067200000 + i * 300000 AS t_ms FROM range(20000) q(i)), own AS (SELECT *, {MAPPED} AS unit_id FROM mixed WHERE signal IN ('click', 'view', 'signup', 'purchase', 'error')),
r AS (SELECT t_ms, own.*, row_number() OVER (PARTITION BY t_ms, device_id, signal ORDER BY ts_ms DESC, id DESC) AS n FROM (SELECT * FROM days WHERE t_ms % 86400000 = 0) d JOIN own ON ts_ms <= t_ms),
u AS (SELECT *, row_number() OVER (PARTITION BY t_ms, unit_id, signal ORDER BY device_id DESC) AS pick FROM r WHERE n = 1), v AS (SELECT * FROM u WHERE pick = 1),
hits AS ({RULE_HITS.format(at='t_ms,')}), best AS (SELECT *, row_number() OVER (PARTITION BY t_ms, unit_id ORDER BY priority DESC, ord) AS b FROM hits)
SELECT t_ms, unit_id, color, text FROM best WHERE b = 1""")
def unit_status_ranges(spark, sf):
    """Ranges over 20 000 probes five minutes apart, looked at where a day begins."""
    probes = spark.range(20_000).select((F.col("id") * 300_000 + 1_704_067_200_000).alias("t_ms"))
    ranges = units.unit_status_ranges(mixed_entries(spark, sf), probes, color_rules(spark), device_mapping(spark))
    days = probes.filter(F.col("t_ms") % 86_400_000 == 0)
    seen = ranges.join(days, F.col("t_ms").between(F.col("from_ms"), F.col("to_ms")))
    return seen.select("t_ms", "unit_id", "color", "text")


@check("SELECT signal FROM (VALUES ('click'), ('view'), ('signup'), ('purchase'), ('idle'), ('error')) r(signal) WHERE signal NOT IN (SELECT event_type FROM events)")
def missing_rule_signals(spark, sf):
    return units.missing_rule_signals(mixed_entries(spark, sf), color_rules(spark))


CAR = (
    EV
    + f""", r AS (SELECT 'CAR' || substr(device_id, 2) AS carrier_id, CASE WHEN k % 17 = 0 THEN '' ELSE 'UNIT' || (k % 10) END AS unit_id, ts_ms,
  row_number() OVER (PARTITION BY device_id ORDER BY ts_ms DESC, id DESC) AS n FROM ev WHERE ts_ms <= {T_MS}),
here AS (SELECT carrier_id, unit_id, ts_ms FROM r WHERE n = 1 AND unit_id <> '')"""
)


@check(f"WITH {CAR} SELECT * FROM here")
def carrier_locations(spark, sf):
    return units.carrier_locations(carriers(spark, sf), T_MS)


@check(f"""WITH {CAR}, c AS (SELECT unit_id, count(*) AS n FROM here GROUP BY 1), u AS (SELECT 'UNIT' || i AS unit_id FROM range(12) t(i))
SELECT unit_id, coalesce(n, 0) AS carriers, CASE WHEN coalesce(n, 0) >= 4 THEN '4+' ELSE CAST(coalesce(n, 0) AS VARCHAR) END AS count_class FROM u LEFT JOIN c USING (unit_id)""")
def unit_carrier_counts(spark, sf):
    known = spark.range(12).select(F.concat(F.lit("UNIT"), F.col("id")).alias("unit_id"))
    return units.unit_carrier_counts(carriers(spark, sf), T_MS, known)


@check(f"""WITH {CAR}, c AS (SELECT unit_id, count(*) AS carriers, min(carrier_id) AS one FROM here GROUP BY 1)
SELECT unit_id, carrier_id, carriers, CASE WHEN carriers > 1 THEN carriers || 'x' WHEN length(one) > 6 THEN '...' || right(one, 6) ELSE one END AS label FROM here JOIN c USING (unit_id)""")
def carriers_at_unit(spark, sf):
    return units.carriers_at_unit(carriers(spark, sf), T_MS)


@check(f"WITH {EV} SELECT 'CAR' || substr(device_id, 2) AS carrier_id, CASE WHEN k % 17 = 0 THEN '' ELSE 'UNIT' || (k % 10) END AS location, ts_ms FROM ev WHERE ts_ms BETWEEN {START_MS} AND {END_MS}")
def carrier_entries(spark, sf):
    return units.carrier_entries(carriers(spark, sf), START_MS, END_MS)


@check("""SELECT min(CAST(p_size AS DOUBLE)) AS min_x, min(CAST(p_partkey AS DOUBLE)) AS min_y, CAST(max(p_size + 2.5) AS DOUBLE) AS max_x, max(p_partkey + CAST(p_size AS DOUBLE)) AS max_y FROM part WHERE p_partkey % 3 <> 0""")
def layout_extent(spark, sf):
    part = table(spark, sf, "part")
    bad = F.col("p_partkey") % 3 == 0
    layout = part.select(
        F.when(bad, F.concat(F.lit("x"), F.col("p_size"))).otherwise(F.concat_ws(", ", "p_size", "p_partkey")).alias("location"),
        F.concat(F.lit("2.5, "), F.col("p_size")).alias("size"),
    )
    return units.layout_extent(layout)

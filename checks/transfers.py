from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from sigtrail.adapters import table, transfers
from sigtrail.functions.transfer import rack_coordinate, resolve_transfer_location, unpack_transfer
from sigtrail.operators import transfers as heat

# Line items as transfers between racks; only open ones are completed.
LI = """li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_returnflag,
  (1 + l_suppkey % 2) || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS src,
  (1 + l_partkey % 2) || lpad(CAST(l_orderkey % 1000 AS VARCHAR), 3, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS dst FROM lineitem)"""
CELLS = (
    LI
    + """, hits AS (SELECT src AS rack FROM li WHERE l_linestatus = 'O' UNION ALL SELECT dst FROM li WHERE l_linestatus = 'O' AND l_returnflag <> 'R'),
cells AS (SELECT CAST(substr(rack, 1, 1) AS INTEGER) AS z, CAST(substr(rack, 5, 2) AS INTEGER) AS y, CAST(substr(rack, 2, 3) AS INTEGER) AS x,
  'Z' || substr(rack, 1, 1) || '-' || substr(rack, 5, 2) AS y_key, rack AS rack_id, count(*) AS hits FROM hits GROUP BY rack)"""
)


@check(f"""WITH {LI} SELECT CAST(l_linenumber AS VARCHAR) AS cmd_id, CASE WHEN l_linestatus = 'O' THEN ' completed' ELSE 'QUEUED' END AS status,
  src AS source, CASE WHEN l_returnflag = 'R' THEN 'PORT-7' ELSE dst END AS dest, dst AS curr_loc, l_returnflag AS result, count(*) AS n FROM li GROUP BY ALL""")
def unpack_fields(spark, sf):
    rows = transfers(spark, sf).withColumn("_t", unpack_transfer(F.col("val_str"))).select("_t.*")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@check("""WITH t AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'R' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '-a' WHEN 'click' THEN '1234567'
  WHEN 'error' THEN '12 ' || lpad(CAST(user_id AS VARCHAR), 6, '0') ELSE 'dock ' || user_id END AS text FROM events),
r AS (SELECT *, regexp_extract(text, '(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)', 1) AS rack FROM t)
SELECT id, text, nullif(rack, '') AS rack_id, CAST(nullif(substr(rack, 1, 1), '') AS INTEGER) AS z, CAST(nullif(substr(rack, 2, 3), '') AS INTEGER) AS x,
  CAST(nullif(substr(rack, 5, 2), '') AS INTEGER) AS y, CASE WHEN rack <> '' THEN 'Z' || substr(rack, 1, 1) || '-' || substr(rack, 5, 2) END AS y_key FROM r""")
def rack_coordinates(spark, sf):
    kind = F.col("event_type")
    six = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    text = (
        F.when(kind == "view", F.concat(F.lit("R"), six("event_id"), F.lit("-a")))
        .when(kind == "click", F.lit("1234567"))
        .when(kind == "error", F.concat(F.lit("12 "), six("user_id")))
        .otherwise(F.concat(F.lit("dock "), F.col("user_id").cast("string")))
    )
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), text.alias("text"))
    rows = rows.withColumn("_r", rack_coordinate(F.col("text")))
    return rows.select("id", "text", "_r.rack_id", "_r.z", "_r.x", "_r.y", "_r.y_key")


@check("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'sn0' WHEN l_returnflag = 'N' THEN ' ' ELSE 'P' || l_suppkey END AS place,
  CASE WHEN l_linestatus = 'F' THEN 'none' ELSE '2' || lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') END AS a, 'x' || lpad(CAST(l_suppkey AS VARCHAR), 6, '1') AS b FROM lineitem),
r AS (SELECT *, CASE WHEN trim(place) = '' OR upper(trim(place)) = 'SN0' THEN coalesce(nullif(regexp_extract(a, '(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(b, '(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)', 1), ''), trim(place)) ELSE trim(place) END AS location FROM t)
SELECT place, a, b, location, count(*) AS n FROM r GROUP BY ALL""")
def resolve_location(spark, sf):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    place = F.when(flag == "A", "sn0").when(flag == "N", " ").otherwise(F.concat(F.lit("P"), F.col("l_suppkey")))
    a = F.when(status == "F", "none").otherwise(F.concat(F.lit("2"), F.lpad((F.col("l_partkey") % 100000).cast("string"), 5, "0")))
    b = F.concat(F.lit("x"), F.lpad(F.col("l_suppkey").cast("string"), 6, "1"))
    rows = table(spark, sf, "lineitem").select(place.alias("place"), a.alias("a"), b.alias("b"))
    rows = rows.withColumn("location", resolve_transfer_location(F.col("place"), [F.col("a"), F.col("b")]))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@check(f"WITH {CELLS} SELECT * FROM cells")
def transfer_heatmap(spark, sf):
    return heat.transfer_heatmap(transfers(spark, sf))


@check(f"""WITH {CELLS} SELECT CASE grouping(y_key, x) WHEN 1 THEN 'row' WHEN 2 THEN 'column' ELSE 'all' END AS level, y_key, x,
  CAST(sum(hits) AS BIGINT) AS total, max(hits) AS peak, count(*) AS racks FROM cells GROUP BY GROUPING SETS ((y_key), (x), ())""")
def heatmap_margins(spark, sf):
    return heat.heatmap_margins(heat.transfer_heatmap(transfers(spark, sf)))


@check(f"WITH {CELLS} SELECT (SELECT count(*) FROM li WHERE l_linestatus = 'O') AS transfer_rows, CAST(sum(hits) AS BIGINT) AS total_hits, count(*) AS rack_count, max(hits) AS max_hits FROM cells")
def heatmap_totals(spark, sf):
    return heat.heatmap_totals(transfers(spark, sf))


def _intensity(mode):
    def run(spark, sf):
        cells = heat.heatmap_intensity(heat.transfer_heatmap(transfers(spark, sf)), mode)
        return cells.select("rack_id", "hits", F.round("intensity", 6).alias("intensity"))

    run.__name__ = f"heatmap_intensity_{mode}"
    return run


_PEAK = {
    "global": "hits / (SELECT max(hits) FROM cells)",
    "row": "hits / max(hits) OVER (PARTITION BY y_key)",
    "column": "hits / max(hits) OVER (PARTITION BY x)",
    "log": "ln(hits + 1) / ln((SELECT max(hits) FROM cells) + 1)",
}
for _mode, _ratio in _PEAK.items():
    check(f"WITH {CELLS} SELECT rack_id, hits, round({_ratio}, 6) AS intensity FROM cells")(_intensity(_mode))

_LABELS = "'X' || lpad(CAST({x} AS VARCHAR), 3, '0') AS x_label, 'Z' || {z} || '-Y' || lpad(CAST({y} AS VARCHAR), 2, '0') AS y_label"


@check(f"WITH {CELLS}, l AS (SELECT *, {_LABELS.format(x='x', y='y', z='z')} FROM cells) SELECT z, y, x, y_key, x_label, y_label, hits FROM l WHERE contains(lower(x_label), '1') AND contains(lower(y_label), '1') AND hits >= 2")
def heatmap_view_filtered(spark, sf):
    return heat.heatmap_view(heat.transfer_heatmap(transfers(spark, sf)), " 1", min_hits=2)


@check(f"""WITH {CELLS}, g AS (SELECT * FROM (SELECT DISTINCT z, y, y_key FROM cells), (SELECT DISTINCT x FROM cells)),
l AS (SELECT g.*, {_LABELS.format(x='g.x', y='g.y', z='g.z')}, coalesce(hits, 0) AS hits FROM g LEFT JOIN cells ON cells.y_key = g.y_key AND cells.x = g.x)
SELECT z, y, x, y_key, x_label, y_label, hits FROM l""")
def heatmap_view_grid(spark, sf):
    return heat.heatmap_view(heat.transfer_heatmap(transfers(spark, sf)), show_zeros=True)

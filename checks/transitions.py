from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import EV, MIXED, check
from sigtrail.adapters import mixed_entries, rule_entries, transition_rules
from sigtrail.operators import filters
from sigtrail.operators import transitions as tact


def found(spark, sf, prefix=""):
    rules = transition_rules(spark, sf).filter(F.col("rule_id").startswith(prefix))
    return tact.transitions(rule_entries(spark, sf), rules), rules


# Rows each rule looks at, with its start (s) and end (e) match.
_ROWS = (
    EV
    + """, matches AS (
  SELECT 'order-' || device_id AS rule_id, 'ab' AS type, ts_ms, id, signal = 'signup' AS s, signal = 'purchase' AND k > 20 AS e, 86400000.0 AS target, 43200000.0 AS tol FROM ev WHERE signal IN ('signup', 'purchase')
  UNION ALL
  SELECT 'flip-' || device_id, 'ab', ts_ms, id, k > 30, k < 60, 172800000.0, 0.0 FROM ev WHERE signal = 'error'
  UNION ALL
  SELECT 'cycle-' || device_id, 'cycle', ts_ms, id, k > 10, false, 259200000.0, 86400000.0 FROM ev WHERE signal = 'click'
  UNION ALL
  SELECT 'fill-' || device_id, 'ab', ts_ms, id, k < 50, k >= 50, NULL, NULL FROM ev WHERE signal = 'view'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts_ms, id) AS n FROM matches),
steps AS (
  SELECT rule_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS armed, CAST(NULL AS BIGINT) AS start_ms, CAST(NULL AS BIGINT) AS end_ms FROM (SELECT DISTINCT rule_id FROM matches)
  UNION ALL
  SELECT r.rule_id, r.n,
    CASE WHEN r.type = 'cycle' THEN CASE WHEN r.s THEN r.ts_ms ELSE p.armed END
         WHEN p.armed IS NULL THEN CASE WHEN r.s THEN r.ts_ms END
         WHEN r.e THEN NULL ELSE p.armed END,
    CASE WHEN p.armed IS NOT NULL AND CASE WHEN r.type = 'cycle' THEN r.s ELSE r.e END THEN p.armed END,
    CASE WHEN p.armed IS NOT NULL AND CASE WHEN r.type = 'cycle' THEN r.s ELSE r.e END THEN r.ts_ms END
  FROM steps p JOIN numbered r ON r.rule_id = p.rule_id AND r.n = p.n + 1),
found AS (
  SELECT s.rule_id, start_ms, end_ms, end_ms - start_ms AS duration_ms,
    CASE WHEN target IS NULL THEN 'no-target' WHEN end_ms - start_ms BETWEEN target - tol AND target + tol THEN 'ok'
         WHEN end_ms - start_ms > target + tol THEN 'above' ELSE 'below' END AS status
  FROM steps s JOIN (SELECT DISTINCT rule_id, target, tol FROM matches) USING (rule_id) WHERE end_ms IS NOT NULL)"""
)
FOUND = f"WITH RECURSIVE {_ROWS}"


@check(f"{FOUND} SELECT * FROM found")
def transitions(spark, sf):
    return found(spark, sf)[0]


@check(f"{FOUND} SELECT * FROM found WHERE rule_id LIKE 'cycle-%'")
def cycle_transitions(spark, sf):
    return tact.cycle_transitions(rule_entries(spark, sf), transition_rules(spark, sf))


@check(f"{FOUND} SELECT * FROM found WHERE rule_id LIKE 'order-%' OR rule_id LIKE 'flip-%'")
def ab_transitions(spark, sf):
    return tact.ab_transitions(rule_entries(spark, sf), transition_rules(spark, sf))


@check(f"{FOUND} SELECT * FROM found WHERE rule_id LIKE 'fill-%'")
def populated_transitions(spark, sf):
    return tact.populated_transitions(rule_entries(spark, sf), transition_rules(spark, sf))


@check(f"{FOUND} SELECT * FROM found WHERE status = 'above'")
def transitions_above(spark, sf):
    return filters.filter_status(found(spark, sf)[0], "above")


@check(f"""{FOUND}, a AS (SELECT rule_id, count(*) AS count, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, CAST(sum(duration_ms) AS BIGINT) AS total_ms,
  avg(duration_ms) AS mean, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.9) AS p90, quantile_cont(duration_ms, 0.95) AS p95, stddev_pop(duration_ms) AS sd,
  min(start_ms) AS first_start_ms, max(end_ms) AS last_end_ms,
  count(*) FILTER (status = 'ok') AS within, count(*) FILTER (status = 'above') AS above, count(*) FILTER (status = 'below') AS below FROM found GROUP BY 1),
r AS (SELECT prefix || device_id AS rule_id, target, tol FROM (SELECT DISTINCT device_id FROM ev), (VALUES ('order-', 86400000.0, 43200000.0), ('flip-', 172800000.0, 0.0), ('cycle-', 259200000.0, 86400000.0), ('fill-', NULL, NULL)) v(prefix, target, tol))
SELECT r.rule_id, coalesce(count, 0) AS count, coalesce(min_ms, 0) AS min_ms, coalesce(max_ms, 0) AS max_ms, coalesce(total_ms, 0) AS total_ms,
  round(coalesce(mean, 0), 3) AS mean_ms, round(coalesce(p50, 0), 3) AS median_ms, round(coalesce(p90, 0), 3) AS p90_ms, round(coalesce(p95, 0), 3) AS p95_ms, round(coalesce(sd, 0), 3) AS stddev_ms,
  coalesce(max_ms - min_ms, 0) AS range_ms, round(CASE WHEN mean > 0 THEN sd / mean ELSE 0 END, 6) AS cv, first_start_ms, last_end_ms,
  coalesce(last_end_ms - first_start_ms, 0) AS elapsed_ms, round(CASE WHEN last_end_ms > first_start_ms THEN count * 3600000.0 / (last_end_ms - first_start_ms) ELSE 0 END, 6) AS throughput_per_hour,
  CAST(target - coalesce(tol, 0) AS DOUBLE) AS target_lower, CAST(target + coalesce(tol, 0) AS DOUBLE) AS target_upper, coalesce(within, 0) AS within, coalesce(above, 0) AS above, coalesce(below, 0) AS below,
  round(coalesce(within * 100.0 / count, 0), 6) AS within_pct, round(coalesce(above * 100.0 / count, 0), 6) AS above_pct, round(coalesce(below * 100.0 / count, 0), 6) AS below_pct
FROM r LEFT JOIN a USING (rule_id)""")
def transition_stats(spark, sf):
    rows, rules = found(spark, sf)
    stats = tact.transition_stats(rows, rules)
    three = ["mean_ms", "median_ms", "p90_ms", "p95_ms", "stddev_ms"]
    six = ["cv", "throughput_per_hour", "within_pct", "above_pct", "below_pct"]
    return stats.withColumns(
        {c: F.round(c, 3) for c in three} | {c: F.round(c, 6) for c in six}
    )


@check(f"{FOUND} SELECT rule_id, start_ms AS time_ms, duration_ms AS value FROM found")
def trend_plain(spark, sf):
    return tact.trend(found(spark, sf)[0])


@check(f"""{FOUND} SELECT rule_id, start_ms AS time_ms, round(avg(duration_ms) OVER w, 3) AS value, count(*) OVER w AS count
FROM found WINDOW w AS (PARTITION BY rule_id ORDER BY start_ms, end_ms ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def trend_moving(spark, sf):
    rows = tact.trend(found(spark, sf)[0], "moving", window=4)
    return rows.withColumn("value", F.round("value", 3))


@check(f"""{FOUND} SELECT rule_id, start_ms // 604800000 * 604800000 AS time_ms, round(avg(duration_ms), 3) AS value, count(*) AS count
FROM found GROUP BY 1, 2""")
def trend_bucket(spark, sf):
    rows = tact.trend(found(spark, sf)[0], "bucket", bucket_minutes=7 * 1440)
    return rows.withColumn("value", F.round("value", 3))


@check(f"""{FOUND}, t AS (SELECT split_part(rule_id, '-', 1) AS rule_id, duration_ms FROM found),
s AS (SELECT rule_id, min(duration_ms) AS lo, greatest(5, CAST(ceil(1 + 3.322 * log10(count(*))) AS INTEGER)) AS bins, CAST(max(duration_ms) - min(duration_ms) AS DOUBLE) AS span FROM t GROUP BY 1),
w AS (SELECT *, CASE WHEN span = 0 THEN 1.0 ELSE span / bins END AS width FROM s),
f AS (SELECT t.rule_id, least(CAST(floor((duration_ms - lo) / width) AS INTEGER), bins - 1) AS bin, count(*) AS count FROM t JOIN w USING (rule_id) GROUP BY 1, 2)
SELECT w.rule_id, CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * width, 3) AS bin_start, round(lo + (b.bin + 1) * width, 3) AS bin_end, coalesce(f.count, 0) AS count,
  coalesce((CASE w.rule_id WHEN 'order' THEN 86400000.0 WHEN 'flip' THEN 172800000.0 WHEN 'cycle' THEN 259200000.0 END) BETWEEN lo + b.bin * width AND lo + (b.bin + 1) * width, false) AS has_target
FROM w, unnest(range(bins)) AS b(bin) LEFT JOIN f ON f.rule_id = w.rule_id AND f.bin = b.bin""")
def duration_histogram(spark, sf):
    """Durations of all users, one histogram per kind of rule."""
    rows, rules = found(spark, sf)
    family = F.split_part("rule_id", F.lit("-"), F.lit(1))
    grouped = rows.withColumn("rule_id", family)
    families = rules.withColumn("rule_id", family).select("rule_id", "target_ms").distinct()
    bins = tact.duration_histogram(grouped, families)
    return bins.withColumns({c: F.round(c, 3) for c in ("bin_start", "bin_end")})


CONDITIONS = [
    ("equals", "true"), ("equals", "42"), ("equals", "42.0"), ("equals", "level 7"), ("not-equals", "42"),
    ("greater", "50"), ("greater", "0"), ("less", "0.5"), ("less", "true"), ("not-empty", None), ("other", "1"),
]
_CONDITIONS = ", ".join("('{}', {})".format(c, "NULL" if v is None else f"'{v}'") for c, v in CONDITIONS)


@check(f"""WITH {MIXED}, c AS (SELECT * FROM (VALUES {_CONDITIONS}) c(condition, wanted)),
p AS (SELECT id, condition, wanted, val_type, val_bool, coalesce(CAST(val_bool AS DOUBLE), CAST(val_int AS DOUBLE), val_float, 0.0) AS num,
  CASE val_type WHEN 0 THEN CASE WHEN val_bool THEN 'true' ELSE 'false' END WHEN 3 THEN val_str END AS text,
  TRY_CAST(wanted AS DOUBLE) AS wanted_num, CASE WHEN wanted = 'true' THEN 1.0 ELSE coalesce(TRY_CAST(wanted AS DOUBLE), 0.0) END AS threshold FROM mixed, c),
e AS (SELECT *, CASE WHEN val_type IN (0, 3) THEN text = wanted ELSE coalesce(num = wanted_num, false) END AS same FROM p)
SELECT id, condition, wanted, CASE condition WHEN 'equals' THEN same WHEN 'not-equals' THEN NOT same WHEN 'greater' THEN num > threshold WHEN 'less' THEN num < threshold
  WHEN 'not-empty' THEN CASE val_type WHEN 0 THEN val_bool WHEN 3 THEN text <> '' ELSE true END ELSE false END AS hit FROM e""")
def conditions(spark, sf):
    tests = F.array(
        *[F.struct(F.lit(c).alias("condition"), F.lit(v).cast("string").alias("wanted")) for c, v in CONDITIONS]
    )
    rows = mixed_entries(spark, sf).select("*", F.inline(tests))
    hit = tact.condition_matches(F.col("condition"), F.col("wanted"))
    return rows.select("id", "condition", "wanted", hit.alias("hit"))

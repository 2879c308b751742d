from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import EV, MIXED, check
from sigtrail.adapters import int_entries, mixed_entries, table
from sigtrail.functions.classify import category_class, severity, signal_pattern
from sigtrail.functions.values import value_text


@check("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'error|fail|critical|fatal') THEN 'error' WHEN regexp_matches(lower(text), 'warn') THEN 'warning'
  WHEN regexp_matches(lower(text), 'success|ok|done|complete') THEN 'success' WHEN regexp_matches(lower(text), 'info|notice|log') THEN 'info' END AS severity FROM documents""")
def text_severity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", severity(F.col("text")).alias("severity"))


@check(f"""WITH {MIXED} SELECT id, CASE WHEN contains(lower(coalesce(val_str, '')), 'fail') THEN 'error' END AS severity FROM mixed""")
def value_severity(spark, sf):
    return mixed_entries(spark, sf).select("id", severity(value_text()).alias("severity"))


@check("""SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'errors' WHEN 'click' THEN 'a-b' WHEN 'purchase' THEN 'ends' END AS pattern FROM events""")
def signal_patterns(spark, sf):
    patterns = [
        ("off", "view", True, False), ("Errors", "(ERROR|ALARM)"), ("A.B", "^CL.CK$"), ("lit", "s.gnup", False), ("Ends", "chase$"),
    ]
    return int_entries(spark, sf).select("id", signal_pattern(F.col("signal"), patterns).alias("pattern"))


@check(f"WITH {EV} SELECT id, CASE signal WHEN 'error' THEN 'error' WHEN 'view' THEN 'p-v-1' END AS class FROM ev")
def category_classes(spark, sf):
    named = F.when(F.col("signal") == "view", "P&V 1").otherwise(F.upper("signal"))
    return int_entries(spark, sf).select("id", category_class(named, ["Error", "p&v 1", "Alarm"]).alias("class"))

"""The canonical ``entries`` layout and the small vocabulary around it.

One row is one signal event.  The value is a tagged union: ``val_type`` names
the active column and the inactive ones are NULL.  ``(source_id, id)`` is
unique and ``id`` follows line order inside a source, so
``(ts_ms, source_id, id)`` is the total order every operator uses.
"""

from __future__ import annotations

from pyspark.sql import types as T

BOOL, INT, FLOAT, STRING = 0, 1, 2, 3

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("val_type", T.ByteType()),
        T.StructField("val_bool", T.BooleanType()),
        T.StructField("val_int", T.LongType()),
        T.StructField("val_float", T.DoubleType()),
        T.StructField("val_str", T.StringType()),
    ]
)
ENTRY_COLUMNS = ENTRY_SCHEMA.names
VALUE_COLUMNS = ["val_type", "val_bool", "val_int", "val_float", "val_str"]

SIGNAL_KEY = ["device_id", "signal"]
TIME_ORDER = ["ts_ms", "source_id", "id"]
INGEST_ORDER = ["source_id", "id"]

ERROR_COLUMNS = ["source_id", "line_key", "content", "reason"]

RULE_SCHEMA = (
    "rule_id string, type string, "
    "start_device string, start_signal string, start_cond string, start_value string, "
    "end_device string, end_signal string, end_cond string, end_value string, "
    "target_ms double, tolerance_ms double"
)
MAPPING_SCHEMA = "ord int, pattern string, unit_id string"
COLOR_RULE_SCHEMA = (
    "ord int, signal string, op string, value string, "
    "color string, bg_color string, text string, priority int"
)
LAYOUT_SCHEMA = "name string, type string, unit_id string, location string, size string"

"""Column expressions over the tagged value of an entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtrail.schema import BOOL, FLOAT, INT, STRING, VALUE_COLUMNS


def value_text(prefix: str = "") -> Column:
    """The active value as text."""
    c = lambda n: F.col(f"{prefix}{n}")
    return (
        F.when(c("val_type") == BOOL, c("val_bool").cast("string"))
        .when(c("val_type") == INT, c("val_int").cast("string"))
        .when(c("val_type") == FLOAT, c("val_float").cast("string"))
        .otherwise(c("val_str"))
    )


def value_number(coerce_numeric: bool = False) -> Column:
    """The value as a number: booleans are 1/0 and strings are 0 unless coerced."""
    text = F.col("val_str").try_cast("double") if coerce_numeric else F.lit(None).cast("double")
    number = (
        F.when(F.col("val_type") == BOOL, F.col("val_bool").cast("double"))
        .when(F.col("val_type") == INT, F.col("val_int").cast("double"))
        .when(F.col("val_type") == FLOAT, F.col("val_float"))
        .otherwise(text)
    )
    return F.coalesce(number, F.lit(0.0))


def value_struct() -> Column:
    """The whole tagged value, for null-safe comparison of two rows."""
    return F.struct(*VALUE_COLUMNS)


def is_empty() -> Column:
    """NULL, '' or false.  The number 0 is a value."""
    return (
        F.when(F.col("val_type") == BOOL, ~F.coalesce("val_bool", F.lit(False)))
        .when(F.col("val_type") == INT, F.col("val_int").isNull())
        .when(F.col("val_type") == FLOAT, F.col("val_float").isNull())
        .otherwise(F.coalesce("val_str", F.lit("")) == "")
    )


def is_high() -> Column:
    """The value reads as a raised boolean: true, "true", 1 or "1"."""
    return (
        F.when(F.col("val_type") == BOOL, F.col("val_bool"))
        .when(F.col("val_type") == INT, F.col("val_int") == 1)
        .when(F.col("val_type") == FLOAT, F.col("val_float") == 1)
        .when(F.col("val_type") == STRING, F.col("val_str").isin("true", "1"))
        .otherwise(False)
    )


def signal_type() -> Column:
    """Reported type name; floats report as strings."""
    return (
        F.when(F.col("val_type") == BOOL, F.lit("boolean"))
        .when(F.col("val_type") == INT, F.lit("integer"))
        .otherwise(F.lit("string"))
    )


def signal_key() -> Column:
    return F.concat_ws("::", "device_id", "signal")


def script_number(col: Column) -> Column:
    """Text as a number the way a browser reads it: '' is 0, words are NULL."""
    text = F.trim(col)
    lowered = F.lower(text)
    numeric = F.rlike(text, F.lit(r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"))
    return F.when(text == "", F.lit(0.0)).when(numeric, lowered.try_cast("double"))

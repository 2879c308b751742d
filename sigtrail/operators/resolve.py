"""One value type per signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.schema import BOOL, ENTRY_COLUMNS, INT, SIGNAL_KEY

# Each file is resolved on its own.
_KEY = ["source_id", *SIGNAL_KEY]


# Bits of ``seen``: what values a signal has had.
_BOOL, _INT, _STRONG, _TEXT = 1, 2, 4, 8


def type_state(entries: DataFrame) -> DataFrame:
    """What is known of each signal's type: ``source_id, device_id, signal, seen, last``.

    ``seen`` has a bit for each kind of value, ``last`` is the row (by line order) and
    kind of the last value that decides under the rule ``last``.  States merge by bitwise
    or and by maximum, so parts of a source may be counted in any order, and twice.
    """
    integer = F.col("val_type") == INT
    strong = integer & ~F.col("val_int").isin(0, 1)
    boolean = F.col("val_type") == BOOL
    text = ~F.col("val_type").isin(BOOL, INT)
    seen = F.when(boolean, _BOOL).when(strong, _INT | _STRONG).when(integer, _INT).when(text, _TEXT).otherwise(0)
    decides = F.when(strong, "integer").when(text, "string")
    last = F.max(F.when(decides.isNotNull(), F.struct("id", decides.alias("kind"))))
    return entries.groupBy(*_KEY).agg(F.bit_or(seen).alias("seen"), last.alias("last"))


def merge_type_states(states: DataFrame) -> DataFrame:
    """One state per signal from those of its parts, in whatever order they came."""
    return states.groupBy(*_KEY).agg(F.bit_or("seen").alias("seen"), F.max("last").alias("last"))


def _kind(rule: str) -> Column:
    has = lambda bit: F.col("seen").bitwiseAND(F.lit(bit)) != 0
    if rule == "any":
        return F.when(has(_STRONG), "integer").when(has(_TEXT), "string").otherwise("boolean")
    if rule == "last":
        return F.coalesce("last.kind", F.lit("boolean"))
    raise ValueError(f"unknown resolution rule: {rule}")


def resolved_kinds(entries: DataFrame, rule: str = "any") -> DataFrame:
    """``source_id, device_id, signal, kind`` with kind boolean, integer or string.

    ``any``: integer once any integer other than 0/1 occurs, else string once any
    text (or decimal) occurs, else boolean.  ``last``: the last row in line order
    that is such an integer or text decides.
    """
    return type_state(entries).select(*_KEY, _kind(rule).alias("kind"))


def apply_types(entries: DataFrame, states: DataFrame, rule: str = "any") -> DataFrame:
    """``entries`` with the types that their signals' states settle.

    Under both rules the booleans of an integer signal become 0/1; ``any`` also
    turns the 0/1 integers of a boolean signal into booleans.  Only signals that
    really mix the two kinds need a change, so only those are joined back.
    """
    kind = _kind(rule)
    to_int = (kind == "integer") & (F.col("seen").bitwiseAND(F.lit(_BOOL)) != 0)
    to_bool = F.lit(rule == "any") & (kind == "boolean") & (F.col("seen").bitwiseAND(F.lit(_INT)) != 0)
    changes = states.filter(to_int | to_bool).select(*_KEY, kind.alias("kind"))
    joined = entries.join(changes, _KEY, "left")
    as_int = F.coalesce((F.col("kind") == "integer") & (F.col("val_type") == BOOL), F.lit(False))
    as_bool = F.coalesce((F.col("kind") == "boolean") & (F.col("val_type") == INT), F.lit(False))
    out = joined.withColumns(
        {
            "val_int": F.when(as_int, F.col("val_bool").cast("long")).when(~as_bool, F.col("val_int")),
            "val_bool": F.when(as_bool, F.col("val_int") != 0).when(~as_int, F.col("val_bool")),
            "val_type": F.when(as_int, F.lit(INT))
            .when(as_bool, F.lit(BOOL))
            .otherwise(F.col("val_type"))
            .cast("byte"),
        }
    )
    return out.select(*ENTRY_COLUMNS)


def resolve_signal_types(entries: DataFrame, rule: str = "any") -> DataFrame:
    """Make booleans and 0/1 integers agree inside each signal of each source."""
    return apply_types(entries, type_state(entries), rule)


def signal_types(entries: DataFrame) -> DataFrame:
    """Reported type per signal; where rows disagree string beats integer beats boolean."""
    rank = F.when(F.col("val_type") == BOOL, 0).when(F.col("val_type") == INT, 1).otherwise(2)
    top = F.max(rank)
    return entries.groupBy(*SIGNAL_KEY).agg(
        F.when(top == 0, "boolean").when(top == 1, "integer").otherwise("string").alias("signal_type")
    )


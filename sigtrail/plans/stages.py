"""Keeping costly expressions from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    They leave through a generator on purpose: conditions on them are then tested on
    its output, where the optimizer would otherwise copy the expressions - with all
    the pattern matching inside - into the filter and into every use.
    """
    cells = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(cells)))

"""Named queries over the given tables, each next to the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Check(NamedTuple):
    run: Query
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; without ``sql`` only rows are checked."""

    def register(fn: Query) -> Query:
        CHECKS[fn.__name__] = Check(fn, sql)
        return fn

    return register


# 2024-01-15 12:00, and the window 2024-01-10 .. 2024-01-20.
T_MS = 1_705_320_000_000
START_MS = 1_704_844_800_000
END_MS = 1_705_708_800_000
DAY_MS = 86_400_000

EV = """ev AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, 'U' || user_id AS device_id,
         event_type AS signal, upper(substr(event_type, 1, 1)) AS category, value,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
  FROM events)"""

# Active value text of the integer and the mixed entries.
MIXED = (
    EV
    + """, mixed AS (
  SELECT *, CASE signal WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS val_type,
    CASE WHEN signal = 'click' THEN k >= 50 END AS val_bool,
    CASE WHEN signal = 'view' THEN k END AS val_int,
    CASE WHEN signal = 'purchase' THEN value END AS val_float,
    CASE signal WHEN 'signup' THEN 'level ' || k WHEN 'error' THEN 'Failed with ' || k END AS val_str
  FROM ev)"""
)

"""Text helpers shared by the log formats."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SPACE = " \t\r\n\x0b\x0c\x85\xa0"
_SEP = "\x01"
BOM = "﻿"


def trim_space(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(_SPACE))


def is_blank(col: Column) -> Column:
    return trim_space(col) == ""


def strip_bom(col: Column) -> Column:
    return F.when(F.startswith(col, F.lit(BOM)), F.substring(col, 2, 1 << 30)).otherwise(col)


def capture(col: Column, pattern: str, groups: int) -> Column:
    """All groups of ``pattern`` as an array, NULL where it does not match.

    One regex pass per row instead of one per group: the whole-line match is
    rewritten as its groups with a separator and split again.
    """
    rewritten = F.regexp_replace(col, pattern, _SEP.join(f"${g}" for g in range(1, groups + 1)))
    return F.when(rewritten != col, F.split(rewritten, _SEP, groups))


def item(array: Column, index: int) -> Column:
    """Array element or NULL, also under ANSI mode."""
    return F.get(array, F.lit(index))


def literal_pattern(text: str) -> str:
    """``text`` as a regex that matches it literally."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def valid_regex(pattern: str) -> bool:
    """Whether the engine that will run a pattern accepts it."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True

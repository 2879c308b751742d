"""Reading values out of log text: timestamps, value types, device ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.functions.text import trim_space
from sigtrail.schema import BOOL, FLOAT, INT, STRING

# Words read as booleans. "0" and "1" stay integers.
TRUE_WORDS = ["ON", "TRUE", "YES"]
FALSE_WORDS = ["OFF", "FALSE", "NO"]

_INTEGER = (
    r"\A[+-]?(?:0[xX]_*[0-9A-Fa-f][0-9A-Fa-f_]*"
    r"|0[bB]_*[01][01_]*"
    r"|0[oO]_*[0-7][0-7_]*"
    r"|[_,]*[0-9][0-9_,]*)\z"
)
_HEX = r"\A(?:0[xX]|[+-]0x)0*([0-9A-Fa-f]{1,16})\z"
_BINARY = r"\A0[bB]0*([01]{1,64})\z"
_CLOCK = r"\A\d{4}.\d{2}.\d{2}.\d{2}.\d{2}.\d{2}"


def parse_ts_ms(col: Column) -> Column:
    """Epoch milliseconds of ``yyyy-MM-dd HH:mm:ss[.fraction]``, else NULL.

    Fields sit at fixed offsets and the text is UTC, so this is integer
    arithmetic on the parts.  A day past the end of its month (30 February)
    rolls into the next month.
    """
    part = lambda at, n: F.substring(col, at, n).try_cast("int")
    year, month, day = part(1, 4), part(6, 2), part(9, 2)
    hour, minute, second = part(12, 2), part(15, 2), part(18, 2)
    fraction = F.substring(col, 21, 9)
    millis = F.when(
        (F.substring(col, 20, 1) == ".") & F.rlike(fraction, F.lit(r"\A\d+\z")),
        F.rpad(F.substring(fraction, 1, 3), 3, "0").try_cast("int"),
    ).otherwise(0)
    valid = (
        F.rlike(col, F.lit(_CLOCK))
        & month.between(1, 12)
        & day.between(1, 31)
        & (hour <= 23)
        & (minute <= 59)
        & (second <= 59)
    )
    first = F.unix_date(F.make_date(year, F.when(valid, month), F.lit(1)))
    days = (first + day - 1).cast("long")
    seconds = days * 86400 + hour * 3600 + minute * 60 + second
    return F.when(valid, seconds * 1000 + millis)


def _type_of(text: Column) -> Column:
    return (
        F.when(F.upper(text).isin(TRUE_WORDS + FALSE_WORDS), F.lit("boolean"))
        .when(F.rlike(text, F.lit(_INTEGER)), F.lit("integer"))
        .otherwise(F.lit("string"))
    )


def infer_type(col: Column) -> Column:
    """``boolean``, ``integer`` or ``string``; decimals count as strings."""
    return _type_of(trim_space(col))


def tagged(
    boolean: Column | None = None,
    integer: Column | None = None,
    number: Column | None = None,
    string: Column | None = None,
) -> Column:
    """Tagged value holding the first non-null of the given alternatives."""
    b = F.lit(None).cast("boolean") if boolean is None else boolean
    i = F.lit(None).cast("long") if integer is None else integer
    d = F.lit(None).cast("double") if number is None else number
    s = F.lit(None).cast("string") if string is None else string
    kind = (
        F.when(b.isNotNull(), F.lit(BOOL))
        .when(i.isNotNull(), F.lit(INT))
        .when(d.isNotNull(), F.lit(FLOAT))
        .otherwise(F.lit(STRING))
    )
    return F.struct(
        kind.cast("byte").alias("val_type"),
        b.alias("val_bool"),
        F.when(kind == INT, i).alias("val_int"),
        F.when(kind == FLOAT, d).alias("val_float"),
        F.when(kind == STRING, s).alias("val_str"),
    )


def with_value(df: DataFrame, raw: str, stype: Column | None = None, name: str = "value") -> DataFrame:
    """Add the tagged value of the text column ``raw``, read as ``stype`` (else inferred).

    Text that does not fit its type stays a string.  Integers are decimal, ``0x`` or
    ``0b`` with ``_`` and ``,`` dropped, and have to fit 64 bits.  The steps are columns
    of their own, so that none is evaluated - or compiled - more than once.
    """
    text, kind, digits = F.col("_text"), F.col("_stype"), F.col("_digits")
    upper = F.upper(text)
    words = F.when(upper.isin(TRUE_WORDS), F.lit(True)).when(upper.isin(FALSE_WORDS), F.lit(False))
    marked = lambda *marks: reduce(Column.__or__, [F.contains(digits, F.lit(m)) for m in marks])
    sign = F.when(F.startswith(digits, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    integer = (
        F.when(F.col("_hex") != "", F.concat(sign, F.conv("_hex", 16, 10)).try_cast("long"))
        .when(F.col("_bin") != "", F.conv("_bin", 2, 10).try_cast("long"))
        .otherwise(digits.try_cast("long"))
    )
    steps = (
        df.withColumn("_text", trim_space(F.col(raw)))
        .withColumn("_stype", _type_of(text) if stype is None else stype)
        .withColumns(
            {
                "_digits": F.when(kind == "integer", F.translate(text, ",_", "")),
                "_bool": F.when(kind == "boolean", words),
            }
        )
        .withColumns(
            {
                "_hex": F.when(marked("x", "X"), F.regexp_extract(digits, _HEX, 1)),
                "_bin": F.when(marked("b", "B"), F.regexp_extract(digits, _BINARY, 1)),
            }
        )
        .withColumn("_int", integer)
    )
    value = tagged(boolean=F.col("_bool"), integer=F.col("_int"), string=text)
    return steps.withColumn(name, value).drop(
        "_text", "_stype", "_digits", "_bool", "_hex", "_bin", "_int"
    )


def extract_device_id(col: Column) -> Column:
    """Device id at the end of a path such as ``Area/Zone.DEV-12@B7`` -> ``DEV-12``, else ''."""
    return F.regexp_extract(col, r"(?:\A|[/\\\].])([A-Za-z0-9_-]+)(?:@[^/\\\].]*)?\z", 1)

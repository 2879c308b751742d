"""Transfer records: the packed value, rack ids and location fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtrail.functions.text import trim_space

# Field order of the packed transfer value.
TRANSFER_FIELDS = ["cmd_id", "status", "source", "dest", "curr_loc", "result"]

# Six digits on their own: one for z, three for x, two for y.
_RACK = r"(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)"


def pack_transfer(fields: Sequence[Column]) -> Column:
    return F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields])


def transfer_field(col: Column, name: str) -> Column:
    """One field of a packed value, '' when missing."""
    return F.split_part(
        F.coalesce(col, F.lit("")), F.lit("|"), F.lit(TRANSFER_FIELDS.index(name) + 1)
    )


def unpack_transfer(col: Column) -> Column:
    return F.struct(*[transfer_field(col, n).alias(n) for n in TRANSFER_FIELDS])


def rack_id(col: Column) -> Column:
    """First free-standing six-digit rack id in the text, else ''."""
    return F.regexp_extract(col, _RACK, 1)


def rack_parts(rack: Column) -> Column:
    """A rack id and its z/x/y parts."""
    z, x, y = F.substring(rack, 1, 1), F.substring(rack, 2, 3), F.substring(rack, 5, 2)
    return F.struct(
        rack.alias("rack_id"),
        z.try_cast("int").alias("z"),
        x.try_cast("int").alias("x"),
        y.try_cast("int").alias("y"),
        F.concat(F.lit("Z"), z, F.lit("-"), y).alias("y_key"),
    )


def rack_coordinate(col: Column) -> Column:
    """Rack id and its parts, NULL where the text has none."""
    rack = rack_id(F.coalesce(col, F.lit("")))
    return F.when(rack != "", rack_parts(rack))


def resolve_transfer_location(primary: Column, fallbacks: Sequence[Column]) -> Column:
    """``primary``, or the first rack id in ``fallbacks`` when it is blank or ``SN0``."""
    text = trim_space(F.coalesce(primary, F.lit("")))
    unresolved = (text == "") | (F.upper(text) == "SN0")
    racks = [F.nullif(rack_id(trim_space(f)), F.lit("")) for f in fallbacks]
    return F.when(unresolved, F.coalesce(*racks, text)).otherwise(text)


def first_filled(columns: Sequence[Column]) -> Column:
    """First column that is not blank, else ''."""
    return F.coalesce(*[F.nullif(trim_space(c), F.lit("")) for c in columns], F.lit(""))

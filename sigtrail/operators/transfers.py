"""Transfer heatmap over rack coordinates.

A rack id has six digits, so there are at most a million cells, a thousand
columns and a thousand rows, however many transfers there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.functions.transfer import rack_id, rack_parts, transfer_field
from sigtrail.operators.filters import completed_transfers
from sigtrail.plans.stages import bind

_GLOBAL, _ROW, _COLUMN, _LOG = "global", "row", "column", "log"


def _rack_ends(entries: DataFrame) -> DataFrame:
    """Completed transfers with the rack ids of source and destination ('' for none)."""
    packed = F.col("val_str")
    return bind(
        completed_transfers(entries),
        _source=rack_id(transfer_field(packed, "source")),
        _dest=rack_id(transfer_field(packed, "dest")),
    )


def transfer_hits(entries: DataFrame) -> DataFrame:
    """One row per completed transfer and rack end (source, destination) that has coordinates."""
    ends = F.array(
        *[
            F.struct(F.lit(end).alias("end"), F.col(f"_{end}").alias("rack"))
            for end in ("source", "dest")
        ]
    )
    hits = _rack_ends(entries).select("source_id", "id", F.inline(ends)).filter("rack <> ''")
    return hits.select("source_id", "id", "end", rack_parts(F.col("rack")).alias("_r")).select(
        "source_id", "id", "end", "_r.*"
    )


def transfer_heatmap(entries: DataFrame) -> DataFrame:
    """Hits per rack cell."""
    ends = _rack_ends(entries).select(F.explode(F.array("_source", "_dest")).alias("rack"))
    # Grouping by the id alone keeps the key short; its parts follow from it.
    cells = ends.filter("rack <> ''").groupBy("rack").agg(F.count(F.lit(1)).alias("hits"))
    return cells.select(rack_parts(F.col("rack")).alias("_r"), "hits").select(
        "_r.z", "_r.y", "_r.x", "_r.y_key", "_r.rack_id", "hits"
    )


def heatmap_margins(cells: DataFrame) -> DataFrame:
    """Totals and maxima per row (``y_key``), per column (``x``) and over all cells."""
    sums = cells.groupingSets([["y_key"], ["x"], []], "y_key", "x").agg(
        F.grouping_id().alias("_g"),
        F.sum("hits").alias("total"),
        F.max("hits").alias("peak"),
        F.count(F.lit(1)).alias("racks"),
    )
    level = F.when(F.col("_g") == 1, "row").when(F.col("_g") == 2, "column").otherwise("all")
    return sums.select(level.alias("level"), "y_key", "x", "total", "peak", "racks")


def heatmap_totals(entries: DataFrame) -> DataFrame:
    """Transfers with at least one rack, rack hits, distinct racks and the largest cell."""
    rows = _rack_ends(entries).agg(F.count_if((F.col("_source") != "") | (F.col("_dest") != ""))).scalar()
    return transfer_heatmap(entries).agg(
        rows.alias("transfer_rows"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits"),
        F.count(F.lit(1)).alias("rack_count"),
        F.coalesce(F.max("hits"), F.lit(0)).alias("max_hits"),
    )


def heatmap_intensity(cells: DataFrame, mode: str = _GLOBAL) -> DataFrame:
    """Cell strength in 0..1 against the largest cell of the map, its row or its column."""
    if mode == _ROW:
        peak: Column = F.max("hits").over(Window.partitionBy("y_key"))
    elif mode == _COLUMN:
        peak = F.max("hits").over(Window.partitionBy("x"))
    else:
        peak = cells.agg(F.max("hits")).scalar()
    hits = F.col("hits")
    ratio = F.ln(hits + 1) / F.ln(peak + 1) if mode == _LOG else hits / peak
    strength = F.when((hits > 0) & (peak > 0), ratio).otherwise(0.0)
    return cells.withColumn("intensity", strength)


def x_label(x: Column) -> Column:
    return F.concat(F.lit("X"), F.lpad(x.cast("string"), 3, "0"))


def y_label(z: Column, y: Column) -> Column:
    return F.concat(F.lit("Z"), z.cast("string"), F.lit("-Y"), F.lpad(y.cast("string"), 2, "0"))


def heatmap_view(
    cells: DataFrame, location: str = "", min_hits: int = 1, show_zeros: bool = False
) -> DataFrame:
    """Cells of the rows and columns whose labels contain ``location``.

    With ``show_zeros`` every remaining row meets every remaining column.
    """
    wanted = location.strip().lower()
    columns = cells.select("x").distinct().filter(F.contains(F.lower(x_label(F.col("x"))), F.lit(wanted)))
    rows = (
        cells.select("z", "y", "y_key")
        .distinct()
        .filter(F.contains(F.lower(y_label(F.col("z"), F.col("y"))), F.lit(wanted)))
    )
    if show_zeros:
        # At most a thousand column numbers.
        axis = columns.agg(F.sort_array(F.collect_list("x"))).scalar()
        grid = rows.withColumn("x", F.explode(axis))
        joined = grid.join(cells.select("y_key", "x", "hits"), ["y_key", "x"], "left")
        shown = joined.withColumn("hits", F.coalesce("hits", F.lit(0)))
        shown = shown.filter((F.col("hits") >= min_hits) | (F.col("hits") == 0))
    else:
        label_x, label_y = F.lower(x_label(F.col("x"))), F.lower(y_label(F.col("z"), F.col("y")))
        shown = cells.filter(
            F.contains(label_x, F.lit(wanted))
            & F.contains(label_y, F.lit(wanted))
            & (F.col("hits") >= min_hits)
        )
    return shown.select(
        "z", "y", "x", "y_key", x_label(F.col("x")).alias("x_label"),
        y_label(F.col("z"), F.col("y")).alias("y_label"), "hits",
    )

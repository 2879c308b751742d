"""Analytics over SECS messages (see ``sources.secs`` for reading them)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrail.plans.ordered import OrderedRows
from sigtrail.session import cut_lineage

_ORDER = ["ts_ms", "source_id", "id"]


_ITEM_FIELDS = "seq int, depth int, type string, count int, value string, name string"


def _flat_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before ``items`` on each item's row, and the item."""
    for batch in batches:
        trees = batch.column("items")
        size = trees.value_lengths().fill_null(0).to_numpy()
        item = trees.flatten()
        kind = item.field("kind")
        opens = (pc.equal(kind, "open").cast(pa.int32()).to_numpy(zero_copy_only=False))
        closes = (pc.equal(kind, "close").cast(pa.int32()).to_numpy(zero_copy_only=False))
        message = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size

        def before(steps: np.ndarray) -> np.ndarray:
            """Sum of a message's steps before each of its items."""
            total = np.append(0, np.cumsum(steps))
            return total[:-1] - np.repeat(total[first], size)

        depth, seq = before(opens - closes), before(1 - closes)
        keep = np.flatnonzero(closes == 0)
        at = pa.array(message[keep])
        fields = [item.field(name).take(pa.array(keep)) for name in ("type", "count", "value", "name")]
        own = [name for name in batch.schema.names if name != "items"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name).take(at) for name in own), pa.array(seq[keep].astype(np.int32)), pa.array(depth[keep].astype(np.int32)), *fields],
            names=[*own, "seq", "depth", "type", "count", "value", "name"],
        )


def secs_items(messages: DataFrame, beside: Sequence[str] = ()) -> DataFrame:
    """Item tree as rows: sequence, depth, type, count, value and name, after the columns
    of the message named in ``beside``.

    Running sums inside a message need neither a shuffle nor a sort, and take time in
    proportion to its items.
    """
    own = messages.select("source_id", "id", *beside)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return messages.select(*own.columns, "items").mapInArrow(_flat_items, f"{kinds}, {_ITEM_FIELDS}")


def secs_fields(entries: DataFrame) -> DataFrame:
    """Display text of packed messages; fields of an unreadable value are ''."""
    field = lambda name: F.coalesce(F.get_json_object("val_str", f"$.{name}"), F.lit(""))
    return entries.select(
        "source_id",
        "id",
        field("direction").alias("direction"),
        field("streamFunction").alias("stream_function"),
        F.coalesce(F.get_json_object("val_str", "$.systemByte"), F.lit("0")).alias("system_byte"),
        field("messageDesc").alias("message_body"),
    )


def secs_lanes(entries: DataFrame) -> DataFrame:
    """Rows with their lane, SEND or RECV, from the message or else the category."""
    direction = F.coalesce(F.nullif(F.get_json_object("val_str", "$.direction"), F.lit("")), F.col("category"))
    return entries.withColumn("lane", F.upper(direction)).filter(F.col("lane").isin("SEND", "RECV"))


def secs_transactions(
    messages: DataFrame, segments: int | None = None, by: Sequence[str] = ("source_id",)
) -> DataFrame:
    """Each SEND with the first later RECV of its system byte and the time between.

    System bytes are counted by each piece of equipment for itself, so only messages
    that agree in ``by`` answer each other: by default those of one source.  Name an
    equipment column where equipment has several sources, or none for one equipment.
    """
    lane = F.upper("direction")
    reply = F.when(
        lane == "RECV",
        F.struct("ts_ms", "id", "source_id", "stream_function"),
    )
    scope = [c for c in by if c not in _ORDER]
    slim = messages.filter(lane.isin("SEND", "RECV")).select(
        *scope, "system_byte", *_ORDER, "stream_function", lane.alias("lane"), reply.alias("reply")
    )
    # Messages are parsed once, whatever counts and cuts them below.
    slim = cut_lineage(slim)
    paired = (
        OrderedRows(slim, [*by, "system_byte"], _ORDER, segments)
        .known({"reply": F.col("reply")}, backward=True)
        .frame()
    )
    return paired.filter(F.col("lane") == "SEND").select(
        *scope,
        "system_byte",
        F.col("source_id").alias("send_source"),
        F.col("id").alias("send_id"),
        F.col("ts_ms").alias("send_ms"),
        F.col("stream_function").alias("send_function"),
        F.col("reply.id").alias("recv_id"),
        F.col("reply.ts_ms").alias("recv_ms"),
        F.col("reply.stream_function").alias("recv_function"),
        (F.col("reply.ts_ms") - F.col("ts_ms")).alias("latency_ms"),
    )

"""SECS-II message logs: header line, TransactionTime line, item tree.

A message starts at a line beginning with ``@``, so the scan splits records at
``\\n@`` and every message arrives whole in one row of a splittable read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.functions.text import capture, item, trim_space
from sigtrail.functions.typing import parse_ts_ms, tagged
from sigtrail.plans.stages import bind
from sigtrail.sources.lines import ParsedLog, number_lines, scan_text, split_result

# Header and TransactionTime layouts.
SECS_HEADER = r"^@?(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\^([^^]+)\^([^^]+)\^([^^]+?)\s*$"
SECS_TRANSACTION = (
    r"(?d)^.*?TransactionTime\s*:\s*\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\s+(S\d+F\d+)"
    r"\s*(?:W,\s*)?.*?\s+-\s+(.*?)(?:\s+\[SystemByte\s*=\s*(\d+)\])?\s*$"
)
_MAX_STREAM, _MAX_FUNCTION = 127, 255
# A header that white space stands before; the records of the scan don't end there.
_INDENTED = r"\n(?=[ \t\x0B\f\r\x85\xA0]+@\d{4}/\d{2}/\d{2} )"


# Type, count, the text after it and the closing bracket of one item line.
_ITEM = r"(?s)\A<([^,\x01]*),\s*([+-]?\d{1,9})(?: (.*?)|)\s*(>\.?|)\z"


def _item(parts: Column, text: Column) -> Column:
    """One body line as an item: kind, type, count, value and name.

    ``kind`` is ``open`` (a list whose items follow), ``leaf`` (complete on its
    line), ``close`` or ``bad``.
    """
    name_of = trim_space(item(parts, 0))
    after = trim_space(item(parts, 2))
    is_list = name_of.isin("L", "LIST")
    # The name is in brackets, at once or after a value; a list has no value.
    at_once = F.startswith(after, F.lit("["))
    spaced = F.contains(after, F.lit(" ["))
    value = (
        F.when(is_list | at_once, F.lit(""))
        .when(spaced, trim_space(F.substring_index(after, " [", 1)))
        .otherwise(trim_space(F.substring_index(after, "[", 1)))
    )
    named = (
        F.when(at_once, F.regexp_extract(after, r"\A\[([^\]]*)\]", 1))
        .when(is_list, F.lit(""))
        .when(spaced, F.regexp_extract(after, r" \[([^\]]*)\]", 1))
        .otherwise(F.regexp_extract(after, r"\[([^\]]*)\]", 1))
    )
    return F.struct(
        F.when(F.startswith(text, F.lit(">")), "close")
        .when(parts.isNull(), "bad")
        .when(is_list & (item(parts, 3) == ""), "open")
        .otherwise("leaf")
        .alias("kind"),
        F.when(is_list, F.lit("L")).otherwise(name_of).alias("type"),
        F.coalesce(item(parts, 1).try_cast("int"), F.lit(0)).alias("count"),
        F.coalesce(value, F.lit("")).alias("value"),
        F.coalesce(named, F.lit("")).alias("name"),
    )


def _tree_check(items: Column) -> Column:
    """Walk the items with a stack of children still due.

    Returns how many items the tree takes (``used``) and whether it is complete;
    the walk stops once the root is complete or a line does not fit.
    """
    due_type = "array<int>"
    zero = F.struct(
        F.array().cast(due_type).alias("due"),
        F.lit(0).alias("used"),
        F.lit(False).alias("done"),
        F.lit(False).alias("bad"),
    )

    def step(state, line):
        due, used = state["due"], state["used"]
        depth = F.size(due)
        top = F.get(due, depth - 1)
        parent_full = (depth > 0) & (top <= 0)
        below = F.slice(due, F.lit(1), F.greatest(depth - 1, F.lit(0)))
        child_taken = F.when(depth > 0, F.concat(below, F.array(top - 1))).otherwise(due)
        kind = line["kind"]
        moved = (
            F.when(kind == "open", F.concat(child_taken, F.array(line["count"])))
            .when(kind == "leaf", child_taken)
            .otherwise(below)
            .cast(due_type)
        )
        wrong = (
            (kind == "bad")
            | (kind.isin("open", "leaf") & parent_full)
            | ((kind == "close") & ((depth == 0) | (top > 0)))
        )
        done = ~wrong & (
            ((kind == "leaf") & (depth == 0)) | ((kind == "close") & (depth == 1))
        )
        stopped = state["done"] | state["bad"]
        return F.when(stopped, state).otherwise(
            F.struct(
                moved.alias("due"),
                (used + 1).alias("used"),
                F.coalesce(done, F.lit(False)).alias("done"),
                F.coalesce(wrong, F.lit(True)).alias("bad"),
            )
        )

    return F.aggregate(items, zero, step)


def _json_member(name: str, value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(value == "", F.lit("")).otherwise(
        F.concat(F.lit(f',"{name}":"'), escaped, F.lit('"'))
    )


def _tree_json(items: Column) -> Column:
    """The item tree as JSON text, assembled line by line."""

    def piece(line, at):
        before = F.get(items, at - 1)
        after = F.get(items, at + 1)
        comma = F.when((at > 0) & (before["kind"] != "open") & (line["kind"] != "close"), ",").otherwise("")
        head = F.concat(
            comma,
            F.lit('{"type":"'), line["type"], F.lit('","count":'), line["count"].cast("string"),
            _json_member("value", line["value"]),
            _json_member("name", line["name"]),
        )
        empty_list = after["kind"] == "close"
        closes_items = before["kind"] != "open"
        return (
            F.when(line["kind"] == "leaf", F.concat(head, F.lit("}")))
            .when(line["kind"] == "open", F.concat(head, F.when(empty_list, "").otherwise(',"items":[')))
            .otherwise(F.when(closes_items, "]}").otherwise("}"))
        )

    return F.array_join(F.transform(items, piece), "")


def classify_secs(records: DataFrame) -> DataFrame:
    """One row per message with header fields, checked item list and ``reason``."""
    parts = records.select("source_id", "id", F.posexplode(F.split("line", _INDENTED, -1)).alias("_n", "line"))
    records = parts.withColumn("id", F.col("id") + F.col("_n")).drop("_n")
    lines = bind(records, _lines=F.split(F.replace("line", F.lit("\r"), F.lit("")), "\n"))
    heads = bind(
        lines,
        _h=capture(trim_space(item(F.col("_lines"), 0)), SECS_HEADER, 4),
        _second=item(F.col("_lines"), 1),
        _body=F.transform(F.slice("_lines", 3, 1 << 30), trim_space),
    ).filter(F.col("_h").isNotNull())
    # The body ends at the first line that ends with ">."; what follows is not part of it.
    ends = F.transform("_body", lambda text: F.endswith(text, F.lit(">.")))
    parts = bind(
        heads,
        _t=capture(trim_space(F.col("_second")), SECS_TRANSACTION, 3),
        _ts=F.translate(item(F.col("_h"), 0), "/", "-"),
        _end=F.array_position(ends, F.lit(True)).cast("int"),
        # A file's last record ends in a line break, which is not a body line.
        _has_body=F.exists("_body", lambda text: text != "") | (F.size("_body") > 1),
    )
    body = F.when(F.col("_end") > 0, F.slice("_body", F.lit(1), F.col("_end"))).otherwise(F.col("_body"))
    fields = bind(
        parts,
        ts_ms=parse_ts_ms(F.col("_ts")),
        timestamp=item(F.col("_h"), 0),
        level=item(F.col("_h"), 1),
        log_category=item(F.col("_h"), 2),
        direction=item(F.col("_h"), 3),
        stream_function=item(F.col("_t"), 0),
        stream=F.regexp_extract(item(F.col("_t"), 0), r"^S(\d+)F", 1).try_cast("int"),
        function=F.regexp_extract(item(F.col("_t"), 0), r"F(\d+)$", 1).try_cast("int"),
        wait_bit=F.contains(F.col("_second"), F.lit(" W,")),
        system_byte=F.coalesce(F.nullif(item(F.col("_t"), 2), F.lit("")).try_cast("long"), F.lit(0).cast("long")),
        message_desc=trim_space(item(F.col("_t"), 1)),
        _texts=F.filter(body, lambda text: text != ""),
    )
    # Matching the lines first binds each match for the item built from it.
    matched = bind(fields, _parts=F.transform("_texts", lambda text: capture(text, _ITEM, 4)))
    items = bind(matched, _items=F.zip_with("_parts", "_texts", _item))
    tree = bind(items, _tree=_tree_check(F.col("_items")))
    valid_sf = (F.col("stream") <= _MAX_STREAM) & (F.col("function") <= _MAX_FUNCTION)
    ceid = F.nullif(F.regexp_extract("message_desc", r"CEID\s+(\d+)", 1), F.lit("")).try_cast("int")
    checked = bind(
        tree,
        ceid=F.coalesce(ceid, F.lit(0)),
        items=F.slice("_items", F.lit(1), F.col("_tree.used")),
        reason=F.when(F.col("ts_ms").isNull(), F.lit("invalid SECS timestamp"))
        .when(F.coalesce("_second", F.lit("")) == "", F.lit("unexpected EOF after SECS header"))
        .when(F.col("_t").isNull(), F.lit("malformed TransactionTime line"))
        .when(~F.coalesce(valid_sf, F.lit(False)), F.lit("invalid stream/function code"))
        .when(~F.col("_has_body"), F.lit("unexpected EOF: no SECS message body found"))
        .when(~F.col("_tree.done"), F.lit("SML body parse error")),
    )
    return checked.select(
        "id", "source_id", "line", "ts_ms", "timestamp", "level", "log_category", "direction", "stream", "function",
        "stream_function", "wait_bit", "system_byte", "ceid", "message_desc", "items", "reason",
    )


def read_secs_records(spark: SparkSession, paths) -> DataFrame:
    return number_lines(scan_text(spark, paths, line_sep="\n@"))


def secs_messages(classified: DataFrame) -> DataFrame:
    """Message columns of the well-formed messages."""
    return classified.filter(F.col("reason").isNull()).drop("reason", "line")


def parse_secs(records: DataFrame) -> ParsedLog:
    """Messages as entries: device and signal ``SECS``, category the direction."""
    classified = classify_secs(records)
    ceid = F.when(F.col("ceid") != 0, F.col("ceid"))
    head = F.to_json(
        F.struct(
            F.concat(F.translate(F.replace("timestamp", F.lit(" "), F.lit("T")), "/", "-"), F.lit("Z")).alias("timestamp"),
            "level",
            F.col("log_category").alias("category"),
            "direction",
            "stream",
            "function",
            F.col("stream_function").alias("streamFunction"),
            F.col("wait_bit").alias("waitBit"),
            F.col("system_byte").alias("systemByte"),
            ceid.alias("ceid"),
            F.col("message_desc").alias("messageDesc"),
        )
    )
    packed = F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"body":'),
        _tree_json(F.col("items")),
        F.lit("}"),
    )
    return split_result(
        classified.select(
            "id",
            "source_id",
            "line",
            "ts_ms",
            F.lit("SECS").alias("device_id"),
            F.lit("SECS").alias("signal"),
            F.col("direction").alias("category"),
            tagged(string=packed).alias("value"),
            "reason",
        )
    )


def read_secs(spark: SparkSession, paths) -> ParsedLog:
    return parse_secs(read_secs_records(spark, paths))

"""Row filters.  Each returns a predicate over raw columns, so equality and IN
tests reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.functions.text import literal_pattern, valid_regex
from sigtrail.functions.transfer import transfer_field
from sigtrail.functions.values import value_text
from sigtrail.schema import BOOL, FLOAT, INT, SIGNAL_KEY, STRING

# Names accepted by the type filter.
TYPE_CODES = {"boolean": BOOL, "integer": INT, "float": FLOAT, "string": STRING}


def clean_list(values: Iterable[str] | str | None) -> list[str]:
    """Comma-split, trimmed and de-duplicated parameter values in first-seen order."""
    if values is None:
        return []
    raw = [values] if isinstance(values, str) else values
    parts = (p.strip() for v in raw for p in v.split(","))
    return list(dict.fromkeys(p for p in parts if p))


def split_pair(key: str) -> tuple[str, str] | None:
    parts = key.split("::")
    return (parts[0], parts[1]) if len(parts) == 2 else None


def pair_filter(keys: Iterable[str]) -> Column:
    """Rows of the ``device::signal`` keys; keys of another shape match nothing."""
    devices: dict[str, list[str]] = {}
    for pair in filter(None, map(split_pair, keys)):
        devices.setdefault(pair[1], []).append(pair[0])
    out = F.lit(False)
    for signal, names in devices.items():
        out = out | ((F.col("signal") == signal) & F.col("device_id").isin(names))
    return out


def restrict_to_signals(entries: DataFrame, signals) -> DataFrame:
    """Keep the given signals: ``device::signal`` keys, or a frame with the key columns."""
    if signals is None:
        return entries
    if isinstance(signals, DataFrame):
        # The engine picks the join from the frame's size; no hint is forced.
        return entries.join(signals.select(*SIGNAL_KEY).distinct(), SIGNAL_KEY, "left_semi")
    return entries.filter(pair_filter(signals))


def search_predicate(
    text: str,
    case_sensitive: bool = False,
    regex: bool = False,
    include_category: bool = False,
    ignore_regex_case: bool = False,
) -> Column:
    """Text occurs in device, signal or value (optionally category).

    A regex is case-sensitive and must be valid unless ``ignore_regex_case``: then
    it follows ``case_sensitive``, and an invalid one is searched as plain text.
    """
    fields = [F.col("device_id"), F.col("signal"), F.coalesce(value_text(), F.lit(""))]
    if include_category:
        fields.append(F.col("category"))
    if regex and ignore_regex_case and not valid_regex(text):
        regex, case_sensitive = False, False
    if regex:
        pattern = "(?i)" + text if ignore_regex_case and not case_sensitive else text
        tests = [F.rlike(f, F.lit(pattern)) for f in fields]
    elif case_sensitive:
        tests = [F.contains(f, F.lit(text)) for f in fields]
    else:
        tests = [F.contains(F.lower(f), F.lit(text.lower())) for f in fields]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def search(entries: DataFrame, text: str, **options) -> DataFrame:
    return entries.filter(search_predicate(text, **options)) if text else entries


@dataclass(frozen=True)
class EntryFilter:
    """All conditions hold at once; an empty one is not applied."""

    text: str = ""
    regex: bool = False
    case_sensitive: bool = False
    include_category: bool = False
    categories: tuple = ()
    signal_names: tuple = ()
    device_ids: tuple = ()
    signals: tuple = field(default=())
    signal_type: str = ""
    ignore_regex_case: bool = False

    def predicate(self) -> Column:
        out = F.lit(True)
        if categories := clean_list(self.categories):
            out = out & F.col("category").isin(categories)
        if names := clean_list(self.signal_names):
            out = out & F.col("signal").isin(names)
        if devices := clean_list(self.device_ids):
            out = out & F.col("device_id").isin(devices)
        if self.signal_type in TYPE_CODES:
            out = out & (F.col("val_type") == TYPE_CODES[self.signal_type])
        if keys := clean_list(self.signals):
            out = out & pair_filter(keys)
        if self.text:
            out = out & search_predicate(
                self.text, self.case_sensitive, self.regex, self.include_category, self.ignore_regex_case
            )
        return out


def filter_entries(entries: DataFrame, flt: EntryFilter | None = None, **conditions) -> DataFrame:
    return entries.filter((flt or EntryFilter(**conditions)).predicate())


def search_signals(
    signals: DataFrame,
    text: str = "",
    regex: bool = False,
    signal_type: str = "all",
    changed: DataFrame | None = None,
) -> DataFrame:
    """Narrow a signal list (``device_id, signal, signal_type``).

    A device whose name matches keeps all its signals.  ``changed`` keeps only the
    signals it lists; an invalid regex finds nothing.
    """
    out = signals
    if changed is not None:
        out = out.join(changed.select(*SIGNAL_KEY).distinct(), SIGNAL_KEY, "left_semi")
    if signal_type != "all":
        out = out.filter(F.col("signal_type") == signal_type)
    if text:
        if regex and not valid_regex(text):
            return out.filter(F.lit(False))
        pattern = F.lit("(?i)" + (text if regex else literal_pattern(text)))
        out = out.filter(F.rlike("device_id", pattern) | F.rlike("signal", pattern))
    return out


def filter_status(transitions: DataFrame, status: str = "all") -> DataFrame:
    return transitions if status == "all" else transitions.filter(F.col("status") == status)


def transfer_rows(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("signal") == "Transfer")


def completed_transfers(entries: DataFrame) -> DataFrame:
    status = F.upper(F.trim(transfer_field(F.col("val_str"), "status")))
    return transfer_rows(entries).filter(status == "COMPLETED")

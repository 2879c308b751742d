"""Row classification by severity words, signal-name patterns and category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtrail.functions.text import literal_pattern, valid_regex

# Severity words, first class that matches wins.
SEVERITY_WORDS = [
    ("error", ["error", "fail", "failed", "critical", "fatal"]),
    ("warning", ["warn", "warning"]),
    ("success", ["success", "ok", "done", "complete"]),
    ("info", ["info", "notice", "log"]),
]

# Default signal-name patterns (name, regex).
SIGNAL_PATTERNS = [
    ("Errors", "(ERROR|ALARM|FAULT|FAIL)"),
    ("Warnings", "(WARN|CAUTION)"),
    ("Status OK", "(READY|OK|DONE|SUCCESS)"),
    ("Commands", "(CMD|COMMAND|REQ)"),
    ("Heartbeat", "(HB|HEARTBEAT|ALIVE)"),
]

# Categories that carry a colour by default.
KNOWN_CATEGORIES = ["Alarm", "Error", "Warning", "Status", "Command", "Info"]


def severity(text: Column) -> Column:
    """Severity class of a value text, NULL when no word occurs in it."""
    lowered = F.lower(text)
    out = None
    for name, words in SEVERITY_WORDS:
        hit = F.rlike(lowered, F.lit("|".join(words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "-")


def signal_pattern(name: Column, patterns: Sequence[tuple] = tuple(SIGNAL_PATTERNS)) -> Column:
    """Slug of the first pattern found in a signal name, ignoring case.

    A pattern is ``(label, text[, is_regex[, enabled]])``; an invalid regex is skipped.
    """
    checks = []
    for label, text, *flags in patterns:
        is_regex = flags[0] if flags else True
        if len(flags) > 1 and not flags[1]:
            continue
        regex = text if is_regex else literal_pattern(text)
        if not valid_regex("(?i)" + regex):
            continue
        checks.append(F.when(F.rlike(name, F.lit("(?i)" + regex)), slug(F.lit(label))))
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def category_class(category: Column, known: Sequence[str] = tuple(KNOWN_CATEGORIES)) -> Column:
    """Slug of a known category (case ignored), NULL for any other."""
    lowered = F.lower(F.coalesce(category, F.lit("")))
    return F.when(lowered.isin([k.lower() for k in known]), slug(lowered))

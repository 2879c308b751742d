"""Secret scanning with a trigram inverted index.

From every rule's regular expression a Boolean query over trigrams is derived: a text
without these trigrams can't match.  A block of documents is indexed (a posting list of
documents for each trigram that some query names), the queries are answered by
intersecting and uniting postings, and only the candidates are matched.  Rules without
mandatory trigrams scan every text.  Blocks are independent, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigtrail.llm.scratch import arrow_map, slices
from sigtrail.llm.words import text_bytes

MOST_STRINGS = 32
"""Alternatives that are spelled out; beyond that a part of a query is left open, which
only widens the candidates."""


class Rule(NamedTuple):
    """``pattern`` as ASCII rules; with ``either_case`` letters match both cases."""

    kind: str
    pattern: str
    either_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


# The three kinds that must be reported, in this order.
BASE = (
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    Rule("access", r"AKIA[A-Z0-9]+"),
    Rule("hex", r"[0-9a-f]+"),
)
LEAST = {"assign": 6, "access": 20, "hex": 24}
"""Characters that a base match (of ``assign``: its value) must have."""

# Publicly documented shapes of other credentials.  None can be tried from
# every place of a long run: a run begins once, or what precedes a fixed text is bounded.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("code_host", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("basic_url", r"[a-z][a-z0-9+.-]{0,30}://[^\s/:@]+:[^\s/:@]+@[^\s/:@]+"),
    Rule("bearer", r"bearer\x20+[a-z0-9+/_.=-]{20,}", True),
)


class Query(NamedTuple):
    """Boolean query: ``all`` or ``any`` of trigrams and further queries; an ``all`` of
    nothing holds everywhere."""

    every: bool
    trigrams: frozenset[bytes]
    parts: tuple["Query", ...] = ()

    def open(self) -> bool:
        return self.every and not self.trigrams and not self.parts

    def names(self) -> set[bytes]:
        return set(self.trigrams).union(*(p.names() for p in self.parts))


ANYTHING = Query(True, frozenset())


def _both(a: Query, b: Query) -> Query:
    parts = [q for q in (a, b) if not q.open()]
    if not parts:
        return ANYTHING
    if len(parts) == 1:
        return parts[0]
    flat = [q for q in parts if q.every]
    return Query(True, frozenset().union(*(q.trigrams for q in flat)), tuple(p for q in parts for p in (q.parts if q.every else (q,))))


def _either(parts: list[Query]) -> Query:
    if not parts or any(q.open() for q in parts):
        return ANYTHING
    return parts[0] if len(parts) == 1 else Query(False, frozenset(), tuple(parts))


def _spelled(strings: set[bytes]) -> Query:
    """The query that one of the strings occurs."""
    return _either([Query(True, frozenset(s[i : i + 3] for i in range(len(s) - 2))) for s in strings])


def _fold(text: str) -> bytes:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()


class _Part(NamedTuple):
    """Of a piece of a pattern: all it can match, if few, and what it demands."""

    strings: set[bytes] | None
    demand: Query


def _sequence(parts: Iterator[_Part]) -> _Part:
    """Spell adjoining strings together as long as there are few of them."""
    demand, strings, whole = ANYTHING, {b""}, True
    for part in parts:
        demand = _both(demand, part.demand)
        if part.strings is not None and len(strings) * len(part.strings) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in part.strings}
            continue
        whole = False
        demand = _both(demand, _spelled(strings))
        strings = {b""} if part.strings is None else part.strings
    return _Part(strings, demand) if whole else _Part(None, _both(demand, _spelled(strings)))


def _members(items) -> set[bytes] | None:
    out = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(_fold(chr(value)))
        elif op is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
            out |= {_fold(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_STRINGS else None


def _piece(op, value) -> _Part:
    if op is sre.LITERAL:
        return _Part({_fold(chr(value))}, ANYTHING)
    if op is sre.IN:
        return _Part(_members(value), ANYTHING)
    if op is sre.AT:
        return _Part({b""}, ANYTHING)
    if op is sre.SUBPATTERN:
        return _sequence(_piece(*x) for x in value[3])
    if op is sre.BRANCH:
        ways = [_sequence(_piece(*x) for x in way) for way in value[1]]
        union = set().union(*(w.strings or () for w in ways))
        if all(w.strings is not None for w in ways) and len(union) <= MOST_STRINGS:
            return _Part(union, _either([w.demand for w in ways]))
        return _Part(None, _either([w.demand if w.strings is None else _both(w.demand, _spelled(w.strings)) for w in ways]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        once = _sequence(_piece(*x) for x in inner)
        if most == 1 and least == 0 and once.strings is not None:
            return _Part(once.strings | {b""}, ANYTHING)
        if least == 0:
            return _Part(None, ANYTHING)
        return once if least == most == 1 else _Part(None, once.demand if once.strings is None else _both(once.demand, _spelled(once.strings)))
    return _Part({b""} if op is sre.ASSERT_NOT else None, ANYTHING)


def trigram_query(pattern: str) -> Query:
    """What the lower-cased bytes of every matching text must have."""
    found = _sequence(_piece(*x) for x in sre_parser.parse(pattern, re.ASCII))
    return found.demand if found.strings is None else _both(found.demand, _spelled(found.strings))


class Index(NamedTuple):
    """Posting lists of a block of texts, as one row of flags per trigram."""

    number: dict[bytes, int]
    postings: np.ndarray

    def answer(self, query: Query) -> np.ndarray:
        lists = [self.postings[self.number[t]] for t in query.trigrams] + [self.answer(p) for p in query.parts]
        if not lists:
            return np.full(self.postings.shape[1], query.every)
        return (np.logical_and if query.every else np.logical_or).reduce(lists)


def build_index(texts: pa.Array, number: dict[bytes, int], places: np.ndarray) -> Index:
    """Post the trigrams that ``number`` names; ``places`` maps each code to its number
    plus one."""
    raw, offsets = text_bytes(texts)
    postings = np.zeros((len(number), len(texts)), dtype=bool)
    if len(raw) > 2:
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        low = low.astype(np.int32)
        which = places[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(which)
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[doc + 1]
        postings[which[at[inside]] - 1, doc[inside]] = True
    return Index(number, postings)


_PLACES: dict[frozenset, tuple[dict[bytes, int], np.ndarray]] = {}


def _places(names: frozenset[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    if names not in _PLACES:
        number = {t: i for i, t in enumerate(sorted(names))}
        places = np.zeros(1 << 24, dtype=np.uint8 if len(number) < 256 else np.int32)
        for t, i in number.items():
            places[(t[0] << 16) | (t[1] << 8) | t[2]] = i + 1
        _PLACES[names] = number, places
    return _PLACES[names]


def _spans(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap, without the too short ones of a base rule."""
    least = LEAST.get(rule.kind, 0)
    group = 1 if rule.kind == "assign" else 0
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    Spans are ``kind:start:end`` in code points, the end exclusive, ordered by start,
    then kind as listed, and joined by commas.  The whole text is searched; null counts
    as empty.  Repeated rows, null ids and ties are rows like others; further columns
    aren't read.
    """
    rules = (*BASE, *more)
    # A run of hex digits is maximal, so asking for the least length changes no match.
    matchers = [re.compile(r"[0-9a-f]{24,}") if r.kind == "hex" else r.compiled() for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    names = frozenset().union(*(q.names() for q in queries))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number, places = _places(names)
        for part in slices(batch, 1):
            texts = part.column(1).fill_null("")
            index = build_index(texts, number, places)
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
            for k, (rule, matcher, query) in enumerate(zip(rules, matchers, queries)):
                for i in np.flatnonzero(index.answer(query)):
                    found[i] += [(a, k, b) for a, b in _spans(rule, matcher, texts[int(i)].as_py())]
            counts = [[sum(k == kind for _, k, _ in spans) for spans in found] for kind in range(len(BASE))]
            every = [[(a, b, rules[k].kind) for a, k, b in sorted(spans)] for spans in found]
            base = [_digest([x for x in spans if x[2] in LEAST]) for spans in every]
            columns = [part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array([_digest(s) for s in every], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return arrow_map(docs.select(doc_id, text), rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

"""Main text of web pages by wrappers inferred per host.

A page is a stream of block tags and text slots.  Pages of one host come from few
templates, so their streams are aligned one after the other into a wrapper, a regular
expression without unions: equal tags stay, a run of equal parts becomes a repeated
group, what only some pages have becomes optional, and texts that differ become slots.
Each stream's slots are then judged once, by the blocks they lie in and, on streams
without an article, by whether the wrapper knows their text to change; every page gives
the text of the slots that hold the article.

Streams are counted per host first: a host with very many pages has few distinct streams.
Wrappers of parts of a host's streams are aligned with each other until one is left, so
no task gathers a host.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrail.llm.scratch import arrow_map, drop, slices, staged

PER_TASK = 16
"""Streams or wrappers of a host that one task aligns."""
CELLS = 1 << 18
"""Size of a table up to which parts of streams are aligned exactly."""
REACH = 64
"""How far beyond the last match an item's next occurrence may be in larger parts."""
LONGEST_PERIOD = 12
"""Stream items that a repeated group can have."""

# Element names of HTML.
RAW = frozenset("script style noscript template iframe svg math object textarea select button".split())
TO_THE_END = frozenset("script style textarea".split())
"""Of RAW, those that run to the end of the page without their end tag."""
CONTAINERS = frozenset("html head body div section article main nav header footer aside form ul ol dl table thead tbody tfoot tr figure details dialog menu fieldset blockquote".split())
LEAVES = frozenset("title p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre address figcaption summary legend hr option center".split())
SIDE_ELEMENTS = frozenset("head nav header footer aside form dialog menu".split())
MAIN_ELEMENTS = frozenset(("article", "main"))
UNMARKED = MAIN_ELEMENTS | {"html", "body"}
"""Elements whose classes and ids say nothing of what lies in them."""
FRAME = 2
"""How much more text than all that is in no side part a frame of the page has."""
# Words that classes and ids of the parts around an article have.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget comment comments "
    "reply replies disqus respond feedback form search pagination pager toc copyright".split()
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^<]*\Z""", re.S)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VALUE_SLASH = re.compile(r"""=\s*[^\s"'>]*/\s*\Z""")
_HOST = re.compile(r"://([^/?#]*)")


class Page(NamedTuple):
    """``stream`` of a page, and its blocks as (slot, text, characters in links)."""

    stream: tuple
    blocks: list[tuple[int, str, int]]


def _marks(attributes: str) -> str:
    """Side words among an element's class, id and role, as part of its symbol."""
    if "=" not in attributes:
        return ""
    found = {w for m in _MARKS.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}
    return "".join("." + w for w in sorted(found & (SIDE_WORDS | {"main"})))


def _symbol_of(name: str, attributes: str) -> str:
    marks = _marks(attributes)
    return name + (".main" if ".main" in marks else "") if name in UNMARKED else name + marks


def _raw_ends(html: str, name: str) -> dict[int, int]:
    """Ends of the elements of a name in RAW, by where their start tags end; without
    those that are never closed, or closed at once."""
    tag = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>])[^>]*>.*?(?:</\1\b[^>]*>|\Z)|<(/?){re.escape(name)}(?=[\s/>])((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.S | re.I)
    open_, ends = [], {}
    for m in tag.finditer(html):
        if m[2] is None:
            continue
        if not m[2]:
            if not (m[3].rstrip().endswith("/") and not _VALUE_SLASH.search(m[3])):
                open_.append(m.end())
        elif open_:
            ends[open_.pop()] = m.end()
    return ends


def _raw_items(html: str) -> Iterator[tuple[str, str, int]]:
    """(symbol, text, link characters): tags of blocks, and '#' for each block's text."""
    parts: list[str] = []
    linked, in_link, at, size = 0, 0, 0, len(html)
    raw_ends: dict[str, dict[int, int]] = {}

    def block():
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        return text

    while at < size:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            parts.append(piece)
            linked += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not m[1] and name in TO_THE_END:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
            elif not m[1]:
                if name not in raw_ends:
                    raw_ends[name] = _raw_ends(html, name)
                at = raw_ends[name].get(at, at)
            parts.append(" ")
        elif name in CONTAINERS or name in LEAVES:
            if text := block():
                yield "#", text, linked
            linked = 0
            if m[1]:
                yield f"/{name}", "", 0
            else:
                yield _symbol_of(name, m[3]), "", 0
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = 0 if m[1] else 1
    if text := block():
        yield "#", text, linked


def _slots(symbol) -> int:
    """Text slots of an item; a repeated group is ('+', items)."""
    return sum(map(_slots, symbol[1])) if isinstance(symbol, tuple) else int(symbol == "#")


def _fold(items: list[tuple[object, list[list[int]]]]) -> list[tuple[object, list[list[int]]]]:
    """Make runs of equal parts repeated groups, short parts first.

    An item is its symbol and, for each of its slots, the numbers of the blocks in it.
    """
    for period in range(1, LONGEST_PERIOD + 1):
        at, out = 0, []
        while at < len(items):
            part = [s for s, _ in items[at : at + period]]
            end = at + period
            if len(part) == period and any(s != "#" for s in part) and not (period == 1 and isinstance(part[0], tuple)):
                while [s for s, _ in items[end : end + period]] == part:
                    end += period
            if end > at + period:
                slots = [slot for _, own in items[at : at + period] for slot in own]
                for more in range(at + period, end, period):
                    slots = [a + b for a, b in zip(slots, [slot for _, own in items[more : more + period] for slot in own])]
                out.append((("+", tuple(part)), slots))
                at = end
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _is_side(name: str, marks: list[str]) -> bool:
    return "whole" not in marks and (name in SIDE_ELEMENTS or bool(set(marks) & SIDE_WORDS))


def _frame(raw: list[tuple[str, str, int]]) -> int | None:
    """The side part that frames the page, as its place: of the outermost the longest.

    A container frames the page if all articles lie in it, where there are any, and more
    than FRAME times the text that is in no side part.  So comments or teasers stay side
    parts, also if they are articles, unless they are nearly all of the page.
    """
    open_: list[int] = []
    outer: list[int] = []
    inside: dict[int, list[int]] = {}
    mains = plain = 0
    for k, (symbol, text, _) in enumerate(raw):
        name, *marks = symbol.removeprefix("/").split(".")
        if symbol == "#":
            around = [raw[i][0].split(".") for i in open_]
            if any(n in SIDE_ELEMENTS and n != "form" for n, *_ in around):
                continue
            if not any(_is_side(n, own) for n, *own in around):
                plain += len(text)
            for i in open_:
                inside[i][1] += len(text)
        elif name not in CONTAINERS:
            continue
        elif symbol[0] == "/":
            at = max((n for n, i in enumerate(open_) if raw[i][0].split(".")[0] == name), default=None)
            open_ = open_ if at is None else open_[:at]
        else:
            if name in MAIN_ELEMENTS or "main" in marks:
                mains += 1
                for i in open_:
                    inside[i][0] += 1
            if _is_side(name, marks) and not any(_is_side(n, own) for n, *own in (raw[i][0].split(".") for i in open_)):
                outer.append(k)
            open_.append(k)
            inside[k] = [0, 0]
    frames = [(inside[k][1], -k) for k in outer if inside[k][0] + (".main" in raw[k][0]) == mains and inside[k][1] > FRAME * plain]
    return -max(frames)[1] if frames else None


def _around_main(raw: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The items, with frames of the page as no side parts."""
    while (k := _frame(raw)) is not None:
        name, *marks = raw[k][0].split(".")
        raw[k] = (".".join([name, *(m for m in marks if m == "main"), *(["whole"] if name in SIDE_ELEMENTS else [])]), "", 0)
    return raw


def read_page(html: str) -> Page:
    raw = _around_main(list(_raw_items(html or "")))
    texts = [(t, n) for s, t, n in raw if s == "#"]
    items, block = [], 0
    for symbol, _, _ in raw:
        items.append((symbol, [[block]] if symbol == "#" else []))
        block += symbol == "#"
    items = _fold(items)
    slot_of = {b: i for i, blocks in enumerate(slot for _, own in items for slot in own) for b in blocks}
    return Page(tuple(s for s, _ in items), [(slot_of[b], t, n) for b, (t, n) in enumerate(texts)])


class Slot(NamedTuple):
    """What is known of a slot: blocks, smallest and largest digest, characters, those in
    links; smallest and largest digest of the pages that have it."""

    pages: int
    low: int
    high: int
    chars: int
    links: int
    first: int = 0
    last: int = 1


def _add(a: Slot, b: Slot) -> Slot:
    return Slot(a.pages + b.pages, min(a.low, b.low), max(a.high, b.high), a.chars + b.chars, a.links + b.links, min(a.first, b.first), max(a.last, b.last))


class Item(NamedTuple):
    symbol: object
    optional: bool
    slots: list[Slot]


def _symbol(x):
    return (x[0], tuple(map(_symbol, x[1]))) if isinstance(x, (list, tuple)) else x


def load(text: str) -> list[Item]:
    return [Item(_symbol(s), o, [Slot(*x) for x in slots]) for s, o, slots in json.loads(text)]


def dump(items: list[Item]) -> str:
    return json.dumps(items, separators=(",", ":"))


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A long common subsequence as pairs of places, in memory bounded by ``CELLS``.

    Equal ends are matched first.  What is left is solved exactly if it is small; else it
    is split at items that both sides have once, in their longest common order, and
    where there are none, each item meets its next occurrence within reach.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, high, left, right = todo.pop()
        while low < high and left < right and a[low] == b[left]:
            pairs.append((low, left))
            low, left = low + 1, left + 1
        while low < high and left < right and a[high - 1] == b[right - 1]:
            high, right = high - 1, right - 1
            pairs.append((high, right))
        if low == high or left == right:
            continue
        if (high - low) * (right - left) <= CELLS:
            pairs += [(low + i, left + j) for i, j in _longest(a[low:high], b[left:right])]
            continue
        anchors = _once_in_both(a, b, low, high, left, right)
        if not anchors:
            pairs += _within_reach(a, b, low, high, left, right)
            continue
        edges = [(low - 1, left - 1), *anchors, (high, right)]
        pairs += anchors
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(pairs)


def _longest(x: list, y: list) -> list[tuple[int, int]]:
    """Longest common subsequence by its table."""
    best = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
    number: dict = {}
    right = np.array([number.setdefault(v, len(number)) for v in y], dtype=np.int64)
    for i in range(len(x) - 1, -1, -1):
        same = right == number.get(x[i], -1)
        here = np.where(same, best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(here[::-1])[::-1]
    pairs, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _once_in_both(a: list, b: list, low: int, high: int, left: int, right: int) -> list[tuple[int, int]]:
    """Items that occur once on each side, as many as stand in one order."""
    counts = Counter(a[low:high]), Counter(b[left:right])
    at = {x: j for j, x in enumerate(b[left:right], left) if counts[1][x] == 1}
    ends, last, before = [], [], {}
    for i, x in enumerate(a[low:high], low):
        if counts[0][x] == 1 and x in at:
            j = at[x]
            place = bisect_left(ends, j)
            before[j] = (i, last[place - 1] if place else None)
            ends[place : place + 1], last[place : place + 1] = [j], [j]
    chain, j = [], last[-1] if last else None
    while j is not None:
        i, previous = before[j]
        chain.append((i, j))
        j = previous
    return chain[::-1]


def _within_reach(a: list, b: list, low: int, high: int, left: int, right: int) -> list[tuple[int, int]]:
    """Each item with its next occurrence on the other side, if that is near."""
    places = defaultdict(list)
    for j in range(left, right):
        places[b[j]].append(j)
    pairs, j = [], left
    for i in range(low, high):
        own = places.get(a[i], [])
        k = bisect_left(own, j)
        if k < len(own) and own[k] - j <= REACH:
            pairs.append((i, own[k]))
            j = own[k] + 1
    return pairs


def _open_after(open_: list[tuple], symbol: str) -> list[tuple]:
    """The open containers, as (name, *side words), after a tag."""
    name, *marks = symbol.removeprefix("/").split(".")
    if name not in CONTAINERS:
        return open_
    if symbol[0] != "/":
        return [*open_, (name, *marks)]
    at = max((i for i, (n, *_) in enumerate(open_) if n == name), default=None)
    return open_ if at is None else open_[:at]


def _keys(items: list[Item]) -> list[tuple]:
    """Items as they are compared: by symbol and by the telling elements around."""
    open_, keys = [], []
    for x in items:
        around = tuple(c for c in open_ if len(c) > 1 or c[0] in SIDE_ELEMENTS or c[0] in MAIN_ELEMENTS)
        keys.append((x.symbol, around))
        for symbol in _flat(x.symbol):
            open_ = _open_after(open_, symbol)
    return keys


def _as_groups(items: list[Item], groups: set) -> list[Item]:
    """Single occurrences of what the other side repeats, as groups."""
    for group in sorted(groups, key=lambda g: (len(g[1]), repr(g))):
        inner, out, at = list(group[1]), [], 0
        while at < len(items):
            if [x.symbol for x in items[at : at + len(inner)]] == inner:
                part = items[at : at + len(inner)]
                out.append(Item(group, any(x.optional for x in part), [s for x in part for s in x.slots]))
                at += len(inner)
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _groups(items: list[Item]) -> set:
    return {x.symbol for x in items if isinstance(x.symbol, tuple)}


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper of both: common items stay, the others become optional."""
    groups = _groups(a) | _groups(b)
    a, b = _as_groups(a, groups), _as_groups(b, groups)
    out, i, j = [], 0, 0
    for x, y in [*_common(_keys(a), _keys(b)), (len(a), len(b))]:
        out += [k._replace(optional=True) for k in a[i:x]] + [k._replace(optional=True) for k in b[j:y]]
        if x < len(a):
            out.append(Item(a[x].symbol, a[x].optional or b[y].optional, [_add(s, t) for s, t in zip(a[x].slots, b[y].slots)]))
        i, j = x + 1, y + 1
    return out


def _flat(symbol) -> Iterator[str]:
    if isinstance(symbol, tuple):
        for x in symbol[1]:
            yield from _flat(x)
    else:
        yield symbol


def _places(items: list[Item]) -> list[tuple[bool, bool]]:
    """For each slot whether it lies in a side part, and whether in an article."""
    open_, places, leaf = [], [], []
    for symbol in (s for x in items for s in _flat(x.symbol)):
        if symbol == "#":
            side = any(_is_side(n, marks) for n, *marks in open_) or "title" in leaf
            inside = any(n in MAIN_ELEMENTS or "main" in marks for n, *marks in open_)
            places.append((side or bool(set(leaf[1:]) & SIDE_WORDS), inside))
            continue
        name, *marks = symbol.removeprefix("/").split(".")
        leaf = [] if symbol[0] == "/" or name in CONTAINERS else [name, *marks]
        open_ = _open_after(open_, symbol)
    return places


def _own_text(page: Page) -> bytes:
    """Digest of a page's blocks outside side parts that aren't mostly links: equal for
    copies, whatever changes around them."""
    places = _places([Item(s, False, []) for s in page.stream])
    own = "\n".join(t for slot, t, n in page.blocks if not places[slot][0] and 2 * n <= len(t))
    return blake2b(own.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _changes(s: Slot) -> bool:
    """Whether a slot's text changes from page to page and isn't mostly links.

    It is constant only if pages of otherwise different text share it: copies of one
    page, however many, are one page.
    """
    constant = s.low == s.high and s.pages > 1 and s.first != s.last
    return not constant and 2 * s.links <= s.chars


SHARE = 2 / 3
"""Of a part's changing text what one part in it must have to stand for it."""


def article_region(wrapper: list[Item]) -> list[bool]:
    """For each slot whether it lies in the part of the wrapper that holds the article.

    From the whole page on, a part without changing text of its own gives way to the one
    part in it that has most of its changing text.  So frames and the parts around an
    article fall away by where the host's pages differ, whatever they are called; a part
    with headings or paragraphs of its own is the article.
    """
    sides = [side for side, _ in _places(wrapper)]
    slots = [x for item in wrapper for x in item.slots]
    weight = [max(0, s.chars - s.links) if not side and _changes(s) else 0 for s, side in zip(slots, sides)]
    open_, paths, nodes = [], [], 0
    for symbol in (s for x in wrapper for s in _flat(x.symbol)):
        if symbol == "#":
            paths.append([n for _, n in open_])
            continue
        name = symbol.removeprefix("/").split(".")[0]
        if name not in CONTAINERS:
            continue
        if symbol[0] == "/":
            at = max((i for i, (n, _) in enumerate(open_) if n == name), default=None)
            open_ = open_ if at is None else open_[:at]
        else:
            nodes += 1
            open_ = [*open_, (name, nodes)]
    inside, depth = [True] * len(slots), 0
    while True:
        below, own = Counter(), 0
        for path, w, here in zip(paths, weight, inside):
            if here and len(path) > depth:
                below[path[depth]] += w
            elif here:
                own += w
        if own or not below:
            return inside
        best, most = max(below.items(), key=lambda x: (x[1], -x[0]))
        if most < SHARE * sum(below.values()) or not most:
            return inside
        inside = [here and len(path) > depth and path[depth] == best for path, here in zip(paths, inside)]
        depth += 1


def main_slots(wrapper: list[Item], stream: list[Item]) -> list[int]:
    """The slots of a stream that hold main text.

    Slots in side parts never do.  If the stream has an article, all other slots in it
    do, whatever the host's other templates have; else those that change, by what the
    wrapper knows of them, in the part that the wrapper shows to hold the article.
    Where another page's group cuts across the stream, an item may have no counterpart
    in the wrapper; its slots are judged by the stream's pages.
    """
    folded = _as_groups(stream, _groups(wrapper))
    places = _places(folded)
    if any(inside and not side for side, inside in places):
        return [i for i, (side, inside) in enumerate(places) if inside and not side]
    slots = [s for x in folded for s in x.slots]
    own = np.cumsum([0, *[len(x.slots) for x in folded]])
    region, near = article_region(wrapper), article_region(folded)
    known = np.cumsum([0, *[len(x.slots) for x in wrapper]])
    for x, y in _common(_keys(wrapper), _keys(folded)):
        slots[own[y] : own[y + 1]] = wrapper[x].slots
        near[own[y] : own[y + 1]] = region[known[x] : known[x + 1]]
    return [i for i, (side, _) in enumerate(places) if not side and near[i] and _changes(slots[i])]


def _wrappers(streams: DataFrame, per_task: int) -> DataFrame:
    """(host, wrapper): the alignment of all streams of each host."""
    level = streams.select("host", F.col("items").alias("wrapper"))

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(parts["wrapper"]):
            own = load(text)
            whole = own if whole is None else align(whole, own)
        return pd.DataFrame({"host": parts["host"].iloc[:1], "wrapper": [dump(whole)]})

    while True:
        sizes = level.groupBy("host").count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= 1:
            return level
        parts = F.ceil(F.col("count") / per_task)
        dealt = level.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), parts))
        level = staged(dealt.groupBy("host", "part").applyInPandas(merge, "host string, wrapper string"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", per_task: int = PER_TASK) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Blocks stand in page order, two newlines apart; white space inside a block is one
    space.  A page without main text, or null html, has the empty text.  Pages without a
    host count as one host's.  Repeated rows and null ids are pages like others; further
    columns aren't read.
    """
    kind = pages.schema[page_id].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 2):
            read = [read_page(x) for x in part.column(2).to_pylist()]
            hosts = [(m[1].lower() if (m := _HOST.search(u or "")) else "") for u in part.column(1).to_pylist()]
            blocks = [[{"slot": s, "text": t, "links": n} for s, t, n in p.blocks] for p in read]
            columns = [part.column(0), part.column(1), pa.array(hosts), pa.array([json.dumps(p.stream) for p in read]), pa.array([int.from_bytes(_own_text(p), "big", signed=True) for p in read], pa.int64()), pa.array(blocks, pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("links", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "stream", "own", "blocks"])

    schema = f"page_id {kind}, url string, host string, stream string, own long, blocks array<struct<slot: int, text: string, links: int>>"
    read = staged(arrow_map(pages.select(page_id, url, html), rows, schema))
    slots = read.select("host", "stream", "own", F.explode_outer("blocks").alias("b")).select("host", "stream", "own", F.col("b.slot").alias("slot"), F.xxhash64("b.text").alias("digest"), F.length("b.text").alias("chars"), F.col("b.links").alias("links"))
    slots = slots.groupBy("host", "stream", "slot").agg(F.count("*").alias("pages"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("own").alias("first"), F.max("own").alias("last"))
    known = slots.groupBy("host", "stream").agg(F.collect_list(F.struct("slot", "pages", "low", "high", "chars", "links", "first", "last")).alias("slots"))  # one for each slot of the stream

    def as_items(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for stream, slots in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            by_slot = {s["slot"]: Slot(s["pages"], s["low"], s["high"], s["chars"] or 0, s["links"] or 0, s["first"], s["last"]) for s in slots if s["slot"] is not None}
            items, at = [], 0
            for symbol in map(_symbol, json.loads(stream)):
                n = _slots(symbol)
                items.append(Item(symbol, False, [by_slot[at + i] for i in range(n)]))
                at += n
            out.append(dump(items))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["host", "stream", "items"])

    streams = staged(arrow_map(known, as_items, "host string, stream string, items string"))
    wrappers = _wrappers(streams, per_task)

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        main = [main_slots(load(w), load(s)) for s, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(main, pa.list_(pa.int32()))], names=["host", "stream", "main"])

    main = staged(arrow_map(streams.join(wrappers, "host").select("host", "stream", "items", "wrapper"), judged, "host string, stream string, main array<int>"))
    drop(streams)
    out = read.join(main, ["host", "stream"], "left")
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.array_contains("main", b["slot"])), lambda b: b["text"]), "\n\n")
    return out.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))

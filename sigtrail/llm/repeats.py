"""Substring deduplication with prefix-partitioned suffix trees over words.

A window is ``WINDOW`` consecutive words.  All words covered by a window that also starts
earlier are repeats.  Equal windows are found as deep nodes of suffix trees:

* **Anchors.**  Of the prefixes (``PREFIX`` words) of the suffixes that start inside a
  window, the leftmost one with the smallest hash is the window's anchor.  Equal windows
  have equal anchors at equal offsets, so suffixes that start elsewhere need no tree.
* **Leaves.**  A prefix that one place of one text alone has leads to a leaf.  Prefixes
  meet once, as hashes with that of their text; single ones end there.
* **Memory-sized groups.**  The other suffixes are dealt by their prefix, with as many
  words after and before it as a window needs.  A prefix with more suffixes than a group
  may hold is lengthened to the whole windows; a window that is still too frequent is
  itself a deep node, whose places are dealt at random, leave the first of each part and
  settle the rest among those.
* **Subtrees.**  A group's suffixes are sorted; common prefixes of neighbours give the
  internal nodes.  The windows at offset d of suffixes that share a node at depth
  ``WINDOW - d`` and the d words before it are equal: all but the earliest are repeats.

Texts that are copies as a whole are settled by their digest and take part once.
Prefixes are compared by 64 bits of hash, the other words of a window by 32 bits each,
windows of lengthened prefixes by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.llm.scratch import slices, staged
from sigtrail.llm.words import _PLACES, Words, mix, text_bytes, words

WINDOW = 20
PREFIX = 8
GROUP = 1 << 12
"""Suffixes of a group; more only where else over ``MOST_LONGER`` prefixes would be."""
MOST_LONGER = 1 << 20
"""Prefixes that are lengthened; their table is sent to all tasks."""
AT_ONCE = 1 << 16
"""Suffixes that a task makes trees of at once."""
_SALTS = 16
_SINGLE, _SEVERAL, _KNOWN = 0, 1, 2
_NO_ID = (1 << 63) - 1


class Bundles(NamedTuple):
    """Anchors of the windows of some texts: the windows that start ``low`` to ``high``
    words before word ``at`` have it as their anchor."""

    text: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    prefix: np.ndarray


def _hashes(found: np.ndarray, n: int, places: np.ndarray) -> np.ndarray:
    """Hashes of all runs of n words."""
    rows = max(len(found) - n + 1, 0)
    out = np.zeros(rows, dtype=np.uint64)
    for j in range(n):
        out += found[j : j + rows] * places[j]
    return mix(out)


def anchors(found: Words, window: int = WINDOW, prefix: int = PREFIX) -> Bundles:
    count = np.diff(found.first)
    owner = np.repeat(np.arange(len(count)), count)
    grams = _hashes(found.hashes, prefix, _PLACES)
    rows = max(len(owner) - window + 1, 0)
    best, at = grams[:rows].copy(), np.arange(rows)
    for j in range(1, window - prefix + 1):
        other = grams[j : j + rows]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    starts = np.flatnonzero(owner[:rows] == owner[window - 1 :]) if rows else np.zeros(0, np.int64)
    at = at[starts]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return Bundles(owner[starts[first]], at[first], at[first] - starts[last], at[first] - starts[first], best[starts[first]])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _prefixes(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """(kind, prefix, h, n, deal) of a slice of texts.  A prefix that is repeated inside
    the slice is known to be, so its texts needn't meet others; one row stands for them."""
    for batch in batches:
        for part in slices(batch, 1):
            digest = part.column(0).to_numpy()
            _, once = np.unique(digest, return_index=True)
            own = anchors(words(part.column(1), lower=False), window, prefix)
            use = np.isin(own.text, once)
            grams, text = own.prefix[use], own.text[use]
            order = np.lexsort((text, grams))
            grams, text = grams[order], text[order]
            if not len(grams):
                continue
            new = np.append(True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1]))
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(grams)))
            grams, h = grams[first].view(np.int64), digest[text[first]]
            run = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            total = np.add.reduceat(n, run)
            several = np.repeat(total > 1, np.diff(np.append(run, len(grams))))
            told = run[total > 1]
            kind = np.where(several, _KNOWN, _SINGLE)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([kind, np.full(len(told), _SEVERAL)]).astype(np.int32)),
                    _long(np.concatenate([grams, grams[told]])),
                    _long(np.concatenate([h, np.zeros(len(told), np.int64)])),
                    _long(np.concatenate([n, np.zeros(len(told), np.int64)])),
                    _long(np.concatenate([np.where(several, h, grams), grams[told]])),
                ],
                names=["kind", "prefix", "h", "n", "deal"],
            )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, h, n) of prefixes that several texts have or one has several times, from
    rows in the order of the prefix.  Only the last prefix is held, as one row."""
    held = None
    for batch in batches:
        kind, prefix, h, n = (batch.column(i).to_numpy() for i in range(4))
        known = kind == _KNOWN
        yield pa.RecordBatch.from_arrays([_long(x[known]) for x in (prefix, h, n)], names=["prefix", "h", "n"])
        several, prefix, h, n = kind[~known] == _SEVERAL, prefix[~known], h[~known], n[~known]
        out = ~several
        if held is not None:
            prefix, h, n = (np.append(x, y) for x, y in zip(held[:3], (prefix, h, n)))
            several, out = np.append(held[3], several), np.append(not held[3], out)
        if not len(prefix):
            continue
        run = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        length = np.diff(np.append(run, len(prefix)))
        many = np.logical_or.reduceat(several | (h != np.repeat(h[run], length)), run)
        keep = np.repeat(many, length) & out
        yield pa.RecordBatch.from_arrays([_long(x[keep]) for x in (prefix, h, n)], names=["prefix", "h", "n"])
        held = (prefix[-1], h[run[-1]], n[-1], bool(many[-1]))


def _suffixes(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """The suffixes that go into trees: (ord, h, text, listed) to rows of ``_LEAVES``."""
    before = window - prefix
    for batch in batches:
        for part in slices(batch, 2):
            found = words(part.column(2), lower=False)
            own = anchors(found, window, prefix)
            listed = part.column(3)
            edges = np.searchsorted(own.text, np.arange(part.num_rows + 1))
            size = listed.value_lengths().to_numpy()
            offset = np.append(0, np.cumsum(size))
            flat = listed.flatten()
            wanted, parts = flat.field("prefix").to_numpy().view(np.uint64), flat.field("parts").to_numpy()
            deal = np.full(len(own.at), -1)
            for i in range(part.num_rows):
                mine = wanted[offset[i] : offset[i + 1]]
                order = np.argsort(mine)
                here = own.prefix[edges[i] : edges[i + 1]]
                if len(mine) and len(here):
                    at = order[np.minimum(np.searchsorted(mine[order], here), len(mine) - 1)]
                    deal[edges[i] : edges[i + 1]] = np.where(mine[at] == here, parts[offset[i] + at], -1)
            whole, longer = np.flatnonzero(deal == 0), np.flatnonzero(deal > 0)
            code = np.concatenate([np.zeros(before, np.uint32), (found.hashes >> np.uint64(32)).astype(np.uint32), np.zeros(window, np.uint32)])
            around = code[own.at[whole][:, None] + np.arange(before + window)] if len(whole) else np.zeros((0, before + window), np.uint32)
            high = own.high[longer] - own.low[longer] + 1
            each = np.repeat(longer, high)
            start = own.at[each] - own.high[each] + np.arange(len(each)) - np.repeat(np.cumsum(high) - high, high)
            label = [_hashes(found.hashes, window, places)[start] if len(start) else np.zeros(0, np.uint64) for places in (_PLACES, _PLACES[window:])]
            ids = [part.column(i).to_numpy() for i in (0, 1)]
            salt = (mix((ids[0] ^ ids[1]).view(np.uint64)) >> np.uint64(8)).view(np.int64)
            text = np.concatenate([own.text[whole], own.text[each]])
            none = np.zeros(len(whole), np.int64)
            raw = pa.Array.from_buffers(pa.binary(4 * (before + window)), len(whole), [None, pa.py_buffer(np.ascontiguousarray(around))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    _long(np.concatenate([own.prefix[whole], label[0]])),
                    pa.array(np.concatenate([none - 1, salt[own.text[each]] % np.maximum(deal[each], 1)]).astype(np.int32)),
                    _long(np.concatenate([none, label[1].view(np.int64)])),
                    pa.array(ids[0][text]),
                    pa.array(ids[1][text]),
                    pa.array((np.concatenate([own.at[whole], start]) - found.first[text]).astype(np.int32)),
                    pa.array(np.concatenate([own.low[whole], np.zeros(len(each), np.int64)]).astype(np.int32)),
                    pa.array(np.concatenate([own.high[whole], np.zeros(len(each), np.int64)]).astype(np.int32)),
                    pa.concat_arrays([raw, pa.nulls(len(each), pa.binary())]),
                ],
                names=["key", "part", "label", "ord", "h", "at", "low", "high", "around"],
            )


_LEAVES = "key long, part int, label long, ord long, h long, at int, low int, high int, around binary"
_MARKS = "ord long, h long, at int, bits int, key long, label long"


def _groups(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups, of about ``at_once`` rows, from rows in the order of key and part."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= at_once:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key, part = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            if len(cut):
                yield whole.slice(0, cut[-1] + 1)
                whole = whole.slice(cut[-1] + 1)
            held, rows = [whole], whole.num_rows if len(cut) else 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _later(order: np.ndarray, classes: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in ``order`` (by class, then place): where a class begins, and which rows
    are later than the first of their class."""
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in classes])
    first = np.flatnonzero(new)
    of = np.repeat(order[first], np.diff(np.append(first, len(order))))
    return new, np.logical_or.reduce([x[order] != x[of] for x in place])


def subtree_repeats(key: np.ndarray, around: np.ndarray, low: np.ndarray, high: np.ndarray, place: list[np.ndarray], window: int = WINDOW, prefix: int = PREFIX) -> np.ndarray:
    """For each suffix the offsets d (as bits) of windows that start earlier elsewhere.

    ``around`` has the words before and after each suffix's start; ``place`` are the
    columns that order suffixes of equal windows.  Suffixes with different keys are in
    different trees.
    """
    before = window - prefix
    after = around[:, before:].astype(np.uint64)
    if window % 2:
        after = np.pad(after, ((0, 0), (0, 1)))
    packed = (after[:, 0::2] << np.uint64(32)) | after[:, 1::2]
    order = np.lexsort((*packed.T[::-1], key))
    same = around[order[1:], before:] == around[order[:-1], before:]
    common = np.where(same.all(axis=1), window, same.argmin(axis=1))
    common[key[order[1:]] != key[order[:-1]]] = 0
    bits = np.zeros(len(key), dtype=np.int32)
    left = np.zeros(len(key), dtype=np.uint64)
    for d in range(before + 1):
        if d:
            left += around[:, before - d] * _PLACES[d]
        node = np.empty(len(key), dtype=np.int64)
        node[order] = np.append(0, np.cumsum(common < window - d))
        use = np.flatnonzero((low <= d) & (d <= high))
        if len(use) > 1:
            sort = use[np.lexsort((*[x[use] for x in place[::-1]], left[use], node[use]))]
            _, later = _later(sort, [node, left], place)
            bits[sort[later]] |= 1 << d
    return bits


def _trees(batches: Iterator[pa.RecordBatch], window: int, prefix: int, at_once: int) -> Iterator[pa.RecordBatch]:
    for batch in _groups(batches, at_once):
        key, part, label, ids, h, at, low, high = (batch.column(i).to_numpy() for i in range(8))
        found = []
        tree = np.flatnonzero(part < 0)
        if len(tree):
            around = np.frombuffer(b"".join(batch.column(8).take(pa.array(tree)).to_pylist()), np.uint32).reshape(len(tree), -1)
            bits = subtree_repeats(key[tree], around, low[tree], high[tree], [ids[tree], h[tree], at[tree]], window, prefix)
            hit = tree[bits != 0]
            found.append((hit, bits[bits != 0], np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)))
        nodes = np.flatnonzero(part >= 0)
        if len(nodes):
            sort = nodes[np.lexsort((at[nodes], h[nodes], ids[nodes], label[nodes], part[nodes], key[nodes]))]
            new, later = _later(sort, [key, part, label], [ids, h, at])
            hit, open_ = sort[later], sort[new]
            found.append((hit, np.ones(len(hit), np.int32), np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)))
            found.append((open_, np.zeros(len(open_), np.int32), key[open_], label[open_]))
        for rows, bits, keys, labels in found:
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(h[rows]), pa.array(at[rows]), pa.array(bits.astype(np.int32)), pa.array(keys), pa.array(labels)], names=["ord", "h", "at", "bits", "key", "label"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, at_once: int = AT_ONCE) -> DataFrame:
    """(ord, h, marks) of texts that are the first of their copies: for each word ``at``
    of a mark, bit d says that the window d words before it also starts earlier.

    ``docs`` has ``ord`` (long), ``h`` (a hash of the text) and ``text``.
    """
    rows = docs.select("h", "text").mapInArrow(lambda b: _prefixes(b, window, prefix), "kind int, prefix long, h long, n long, deal long")
    dealt = rows.repartition("deal").sortWithinPartitions(F.col("kind") == _KNOWN, "prefix", "kind", "h").drop("deal")
    met = staged(dealt.mapInArrow(_met, "prefix long, h long, n long"))
    total = met.agg(F.sum("n")).first()[0] or 0
    most = max(group, total // MOST_LONGER)
    longer = met.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    parts = longer.select("prefix", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    listed = met.join(F.broadcast(parts), "prefix", "left").groupBy("h").agg(F.collect_set(F.struct("prefix", F.coalesce("parts", F.lit(0)).alias("parts"))).alias("listed"))
    firsts = docs.groupBy("h").agg(F.min("ord").alias("ord"))
    wanted = staged(listed.join(firsts, "h").select("ord", "h", "listed"))
    leaves = docs.join(wanted, ["ord", "h"]).select("ord", "h", "text", "listed").mapInArrow(lambda b: _suffixes(b, window, prefix), _LEAVES)
    trees = leaves.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lambda b: _trees(b, window, prefix, at_once), _MARKS)
    found = staged(trees)
    place = F.struct("ord", "h", "at")
    least = F.min(place).over(Window.partitionBy("key", "label"))
    late = found.where("bits = 0").withColumn("least", least).where(place > F.col("least"))
    marks = found.where("bits > 0").select("ord", "h", "at", "bits").unionByName(late.select("ord", "h", "at", F.lit(1).alias("bits")))
    return marks.groupBy("ord", "h").agg(F.collect_list(F.struct("at", "bits")).alias("marks"))


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, marks, copy, again) to the words that are left."""
    for batch in batches:
        for part in slices(batch, 1):
            texts = part.column(1)
            raw, offsets = text_bytes(texts)
            found = words(texts, lower=False)
            n = np.diff(found.first)
            total = len(found.hashes)
            marks = part.column(2)
            lengths = marks.value_lengths().fill_null(0).to_numpy()
            flat = marks.flatten()
            at, bits = flat.field("at").to_numpy(), flat.field("bits").to_numpy()
            base = np.repeat(found.first[:-1], lengths)
            cover = np.zeros(total + 1, dtype=np.int64)
            for d in range(32):
                start = (base + at - d)[bits >> d & 1 == 1]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            whole = part.column(3).to_numpy(zero_copy_only=False).astype(bool) & (n >= window)
            gone |= np.repeat(whole, n)
            owner = np.repeat(np.arange(len(n)), n)
            removed = np.bincount(owner[gone], minlength=len(n))
            stay = np.flatnonzero(~gone)
            inside = np.zeros(len(raw) + 1, dtype=np.int64)
            inside[found.start[stay]] += 1
            inside[found.end[stay]] -= 1
            use = np.cumsum(inside[:-1]) > 0
            gaps = found.end[stay[:-1]][owner[stay[1:]] == owner[stay[:-1]]]  # one blank after each word but the last
            use[gaps] = True
            out = raw.copy()
            out[gaps] = 32
            sizes = np.append(0, np.cumsum(use))[offsets]
            text = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(out[use])]).cast(pa.string())
            spans = _spans(gone, owner, found.first, len(n))
            yield pa.RecordBatch.from_arrays([part.column(0), _long(n), _long(removed), spans, text, part.column(4), part.column(5)], names=["doc_id", "n_words", "n_removed", "spans", "text", "again", "h"])


def _spans(gone: np.ndarray, owner: np.ndarray, first: np.ndarray, texts: int) -> pa.Array:
    """Runs of removed words of each text, as [start, end) word numbers."""
    new = gone.copy()
    new[1:] &= ~gone[:-1] | (owner[1:] != owner[:-1])
    last = gone.copy()
    last[:-1] &= ~gone[1:] | (owner[1:] != owner[:-1])
    start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    at = owner[start]
    offset = np.append(0, np.cumsum(np.bincount(at, minlength=texts))).astype(np.int32)
    cells = pa.StructArray.from_arrays([_long(start - first[at]), _long(end - first[at])], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offset), cells)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, text) of every document.

    A word is removed if a window of its document covers it whose words also start
    earlier: under a smaller id, or earlier in the same document.  Windows are judged on
    the input.  ``spans`` are the runs of removed words (start, end exclusive), which
    are the document's repeats at full length; ``text`` is the words that are left,
    joined by one space.

    Null texts have no words.  Ids are whole numbers; rows without id come after all
    others.  Rows that share an id follow each other in the order of a hash of their
    texts; one of several rows with equal id and text is the first, the others are its
    copies.  A text with fewer words than a window loses none.  Other columns are not
    read; no rows give no rows.
    """
    if not 0 < prefix < window <= 30:
        raise ValueError("prefixes are shorter than windows, windows have 30 words at most")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("ord"), F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(1), whole).alias("g"), whole.alias("text"))
    marks = repeated_windows(rows.select("ord", "h", "text"), window, prefix, group, at_once)
    light = rows.groupBy("ord", "h", "g").agg(F.count("*").alias("again"))
    several = light.groupBy("h", "g").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    dealt = several.select("h", "g", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    copies = light.withColumn("salt", F.pmod(F.hash("ord"), F.lit(_SALTS))).join(dealt, ["h", "g", "salt"]).where("ord > first")
    settled = copies.select("ord", "h", F.lit(True).alias("copy"), F.lit(None).cast("long").alias("again")).unionByName(
        light.where("again > 1").select("ord", "h", F.lit(False).alias("copy"), "again")
    )
    told = settled.groupBy("ord", "h").agg(F.max("copy").alias("copy"), F.max("again").alias("again"))
    facts = marks.join(told, ["ord", "h"], "full")
    joined = rows.join(facts, ["ord", "h"], "left").select("doc_id", "text", "marks", F.coalesce("copy", F.lit(False)).alias("copy"), "again", "h")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start: long, end: long>>, text string, again long, h long"
    done = joined.mapInArrow(lambda b: _kept(b, window), schema)
    names = ["doc_id", "n_words", "n_removed", "spans", "text"]
    if light.where("again > 1").limit(1).count() == 0:
        return done.select(*names)
    # Rows equal in id and text have come out alike; all but one are copies.
    same = done.where("again IS NOT NULL").groupBy("doc_id", "h").agg(*[F.first(c).alias(c) for c in names[1:]], F.count("*").alias("rows"))
    full = F.col("n_words") >= window
    later = F.struct(
        "n_words",
        F.when(full, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(full, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.col("spans")).alias("spans"),
        F.when(full, F.lit("")).otherwise(F.col("text")).alias("text"),
    )
    first = same.select(*names)
    others = same.select("doc_id", F.explode(F.sequence(F.lit(2).cast("long"), F.col("rows"))).alias("_"), later.alias("x")).select("doc_id", "x.*")
    return done.where("again IS NULL").select(*names).unionByName(first).unionByName(others)

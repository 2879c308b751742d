"""Words, shingles and their 64-bit hashes for a batch of texts at once.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Both rules touch ASCII only, so
they are applied to the UTF-8 bytes, and a whole batch is hashed with array operations.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACES = np.multiply.accumulate(np.full(64, 0xD1342543DE82EF95, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (an invertible finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 22:  # those of one giant text aren't kept
            _POWERS[name] = have
    return have[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    """Hashes of the words of all texts in order; text i has those from first[i] to
    first[i + 1].  ``start`` and ``end`` are byte positions."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words(texts: pa.Array, lower: bool = True) -> Words:
    """With ``lower=False`` words that differ in case differ."""
    raw, offsets = text_bytes(texts)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), none, none)
    inside = ~_SPACE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]  # a text's end is a word's end
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_CODES[_LOWER[raw] if lower else raw] * _powers("base", _BASE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _powers("inverse", _INVERSE, n)[start] + (end - start).astype(np.uint64))
    return Words(hashes, np.searchsorted(start, offsets), start, end)


def shingle_hashes(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and where each text's begin (n + 1).

    A text with fewer words has its whole sequence as its one shingle; one without
    words has none.
    """
    count = np.diff(found.first)
    total = len(found.hashes)
    rows = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(rows)])
    if not total:
        return np.zeros(0, np.uint64), first
    rolled = np.zeros(total, dtype=np.uint64)
    for j in range(min(k, total)):
        rolled[: total - j] += found.hashes[j:] * _PLACES[j]
    at = np.repeat(found.first[:-1] - first[:-1], rows) + np.arange(first[-1])
    out = rolled[at]
    for i in np.flatnonzero((count > 0) & (count < k)):
        whole = found.hashes[found.first[i] : found.first[i + 1]]
        with np.errstate(over="ignore"):  # wraps on purpose
            out[first[i]] = (whole * _PLACES[: len(whole)]).sum(dtype=np.uint64) + _CODES[len(whole)]
    return mix(out), first


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as sorted hashes."""
    hashes, first = shingle_hashes(words(texts), k)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]

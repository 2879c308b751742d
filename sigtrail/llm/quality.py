"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad by a two-state chain whose potentials use
the line's own shape and that of its neighbours.  Forward-backward gives each line's
probability of being good; weighted by line length they make the document's score.

The chain is trained on the driver from a bounded sample of labelled documents, whose
label stands for all their lines; all texts are scored in the executors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sigtrail.llm.scratch import ROW, arrow_map, as_row, quoted, slices
from sigtrail.llm.words import text_bytes, words

SAMPLE_DOCS = 4000
"""Labelled documents the chain is trained on, the first in the order of a hash."""

SAMPLE_LINES = 2000
"""Lines of a document that training uses, so that what the driver gets is bounded;
scoring uses all."""

_NEWLINE = 10
_UPPER, _LOWER, _DIGIT, _HIGH = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = _HIGH[128:] = True
_STOP, _SHOUT, _BAR, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_STOP[[ord(c) for c in ".,;:?"]] = True
_SHOUT[ord("!")] = _BAR[ord("|")] = True
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = True

OWN = ("length", "words", "symbols", "shouts", "bars", "upper", "repeats", "stops", "digits", "word_size", "short", "copies")
AROUND = ("symbols", "shouts", "bars", "upper", "repeats", "stops")
FEATURES = ("bias", *OWN, *[f"{side}_{x}" for side in ("before", "after") for x in AROUND])


class Lines(NamedTuple):
    """Features of all lines; text i has those from first[i] to first[i + 1]."""

    features: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def line_features(texts: pa.Array) -> Lines:
    """Lines end at a newline; an empty or null text is one empty line."""
    raw, offsets = text_bytes(texts)
    breaks = np.flatnonzero(raw == _NEWLINE)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    end = np.append(start[1:], offsets[-1])
    end[np.isin(np.arange(len(start)), first[1:-1] - 1, invert=True)] -= 1  # without the newline
    if len(end):
        end[-1] = offsets[-1]
    size = (end - start).astype(np.float64)

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[raw])])
        return (sums[end] - sums[start]).astype(np.float64)

    found = words(texts)
    at = np.searchsorted(start, found.start, side="right") - 1  # line of each word
    n_words = np.bincount(at, minlength=len(start)).astype(np.float64)
    same = np.zeros(len(at), bool)
    same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (at[1:] == at[:-1])
    same[2:] |= (found.hashes[2:] == found.hashes[:-2]) & (at[2:] == at[:-2])
    repeats = np.bincount(at[same], minlength=len(start))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found.hashes, dtype=np.uint64)])
    edge = np.searchsorted(at, np.arange(len(start) + 1))
    content = sums[edge[1:]] - sums[edge[:-1]]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((content, doc))
    twin = (content[order][1:] == content[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    copies = np.zeros(len(start))
    copies[order[1:][twin]] = copies[order[:-1][twin]] = 1
    copies[n_words == 0] = 0

    bytes_, some_words = np.maximum(size, 1), np.maximum(n_words, 1)
    upper, lower = count(_UPPER), count(_LOWER)
    own = {
        "length": np.log1p(size) / 5, "words": np.log1p(n_words) / 3, "symbols": 10 * count(_SYMBOL) / bytes_, "shouts": 10 * count(_SHOUT) / bytes_, "bars": 2 * count(_BAR) / some_words,
        "upper": 2 * upper / np.maximum(upper + lower, 1), "repeats": 2 * repeats / some_words, "stops": count(_STOP) / some_words, "digits": 5 * count(_DIGIT) / bytes_,
        "word_size": bytes_ / some_words / 10, "short": (n_words < 4).astype(np.float64), "copies": copies,
    }
    own = {name: np.minimum(column, 5.0) for name, column in own.items()}
    starts, ends = np.zeros(len(start), bool), np.zeros(len(start), bool)
    starts[first[:-1]] = ends[first[1:] - 1] = True
    columns = [np.ones(len(start)), *own.values()]
    columns += [np.where(starts, 0, np.roll(own[x], 1)) for x in AROUND]
    columns += [np.where(ends, 0, np.roll(own[x], -1)) for x in AROUND]
    return Lines(np.stack(columns, axis=1), np.maximum(size, 1), first)


class Chain(NamedTuple):
    """``emit`` weighs the features in favour of good; ``move[a, b]`` a step from state
    a to state b (0 bad, 1 good)."""

    emit: np.ndarray
    move: np.ndarray


class Sums(NamedTuple):
    good: np.ndarray
    """Probability of good for each line."""
    log_z: float
    moves: np.ndarray
    """Expected steps between states."""


def _paths(first: np.ndarray):
    """For each place in a text the lines there, longest texts first."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    for t in range(int(count[0]) if len(count) else 0):
        yield begin[: np.searchsorted(-count, -t, side="left")] + t


def forward_backward(chain: Chain, features: np.ndarray, first: np.ndarray) -> Sums:
    """Marginals of all texts' chains, which run side by side."""
    n = len(features)
    score = np.zeros((n, 2))
    score[:, 1] = features @ chain.emit
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    steps = list(_paths(first))
    for t, at in enumerate(steps):
        if t:
            into = ahead[at - 1][:, :, None] + chain.move
            ahead[at] = np.logaddexp(into[:, 0], into[:, 1]) + score[at]
        else:
            ahead[at] = score[at]
    moves = np.zeros((2, 2))
    for at in reversed(steps[1:]):
        out = chain.move + (score[at] + back[at])[:, None, :]
        back[at - 1] = np.logaddexp(out[:, :, 0], out[:, :, 1])
    total = np.logaddexp(ahead[:, 0] + back[:, 0], ahead[:, 1] + back[:, 1]) if n else np.zeros(0)
    for at in steps[1:]:
        both = ahead[at - 1][:, :, None] + chain.move + (score[at] + back[at])[:, None, :] - total[at][:, None, None]
        moves += np.exp(both).sum(axis=0)
    good = np.exp(ahead[:, 1] + back[:, 1] - total)
    return Sums(good, float(total[first[:-1]].sum()) if n else 0.0, moves)


def train(lines: Lines, quality: np.ndarray, rounds: int = 200, penalty: float = 0.1, rate: float = 0.1) -> Chain:
    """Fit by gradient steps of adapted size on the penalised mean log-likelihood."""
    count = np.diff(lines.first)
    label = np.repeat(quality, count)
    wanted = lines.features.T @ label.astype(np.float64)
    steps = np.repeat(quality, np.maximum(count - 1, 0))
    wanted_moves = np.diag([np.sum(steps == 0), np.sum(steps == 1)]).astype(np.float64)
    emit, move, texts = np.zeros(lines.features.shape[1]), np.zeros((2, 2)), max(len(count), 1)
    slow, fast = np.zeros(emit.size + 4), np.zeros(emit.size + 4)
    for i in range(1, rounds + 1):
        got = forward_backward(Chain(emit, move), lines.features, lines.first)
        slope = np.concatenate([wanted - lines.features.T @ got.good - penalty * emit, (wanted_moves - got.moves - penalty * move).ravel()]) / texts
        slow, fast = 0.9 * slow + 0.1 * slope, 0.99 * fast + 0.01 * slope**2
        step = rate * (slow / (1 - 0.9**i)) / (np.sqrt(fast / (1 - 0.99**i)) + 1e-8)
        emit, move = emit + step[:-4], move + step[-4:].reshape(2, 2)
    return Chain(emit, move)


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Chain:
    """Train on up to ``sample_docs`` labelled documents that aren't held out, on the
    first ``sample_lines`` lines of each.

    Rows of ``labels`` without id or label aren't used; without any label the chain is
    neutral and scores 0.5.
    """
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id))
    chosen = usable.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("quality")).orderBy(F.xxhash64("id"), "id", "quality").limit(sample_docs)
    own = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    pairs = own.join(F.broadcast(chosen), own["doc_id"] == chosen["id"]).select("id", "quality", "text")

    def rows(batch: pa.RecordBatch):
        for part in slices(batch, 2):
            lines = line_features(part.column(2))
            each = [pa.array(lines.features[a : min(b, a + sample_lines)].astype(np.float32).ravel()) for a, b in zip(lines.first[:-1], lines.first[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(each, pa.list_(pa.float32()))], names=["id", "quality", "lines"])

    got = arrow_map(pairs, rows, f"id {chosen.schema['id'].dataType.simpleString()}, quality double, lines array<float>").toArrow()
    got = got.sort_by([("id", "ascending"), ("quality", "ascending")]) if got.num_rows else got
    values = got.column("lines").combine_chunks()
    if not got.num_rows:
        return Chain(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    features = values.flatten().to_numpy().astype(np.float64).reshape(-1, len(FEATURES))
    count = np.array([len(x) // len(FEATURES) for x in values])
    lines = Lines(features, np.ones(len(features)), np.concatenate([[0], np.cumsum(count)]))
    return train(lines, (got.column("quality").to_numpy() >= 0.5).astype(np.int64))


def text_scores(chain: Chain, texts: pa.Array) -> np.ndarray:
    lines = line_features(texts)
    good = forward_backward(chain, lines.features, lines.first).good
    if not len(good):
        return np.zeros(0)
    starts = lines.first[:-1]
    return np.clip(np.add.reduceat(good * lines.weight, starts) / np.add.reduceat(lines.weight, starts), 0.0, 1.0)


def score(docs: DataFrame, chain: Chain, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``, 0 to 1, higher for better texts.

    Every whole text is scored by itself, so ties, repeated rows and null ids make no
    difference; null is scored as the empty text.  A column of that name is replaced.
    """
    docs = docs.drop(column)
    at = docs.columns.index(text)

    def rows(batch: pa.RecordBatch):
        for part in slices(pa.RecordBatch.from_struct_array(batch.column(0)), at):
            yield pa.RecordBatch.from_arrays([part.to_struct_array(), pa.array(text_scores(chain, part.column(at)))], names=[ROW, column])

    scored = arrow_map(as_row(docs), rows, StructType([StructField(ROW, docs.schema), StructField(column, DoubleType())]))
    return scored.select(f"{ROW}.*", column)

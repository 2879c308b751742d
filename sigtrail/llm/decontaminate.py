"""Benchmark decontamination: size-partitioned MinHash containment search.

An item (a short test text) is contained in a document when the document has at least
``threshold`` of the item's distinct shingles.  Items are partitioned by their number of
shingles.  A partition has its own sketch length: the bottom-k MinHash of an item keeps
its k smallest shingle hashes, with k one more than the shingles that a document may
lack at this size.  So a document that contains an item has at least one shingle of the
item's sketch, however long the document is: the search misses nothing.  Documents that
meet a sketch are verified by counting exactly the item's shingles that they have.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrail.llm.scratch import ROW, arrow_map, as_row, of_row, slices
from sigtrail.llm.words import shingle_hashes, words

MAX_BROADCAST = 1 << 20
"""Item shingles (8 bytes each) up to which they are sent to all tasks; more are joined."""


def lacking(n: int, threshold: float) -> int:
    """Shingles of an item of ``n`` that a document may lack and still contain it."""
    return n - math.ceil(round(n * threshold, 9))


def size_class(n: int) -> int:
    """Partition of an item: sizes from 2^c to 2^(c + 1) - 1."""
    return n.bit_length() - 1


def sketch_length(size: int, threshold: float) -> int:
    """Bottom-k length for all items of the partition of ``size``."""
    return lacking((2 << size_class(size)) - 1, threshold) + 1


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def item_shingles(items: DataFrame, item_id: str, text: str, k: int, threshold: float) -> DataFrame:
    """(item_id, shingle, n, in_sketch): a row for each distinct shingle of each item."""

    def rows(batch: pa.RecordBatch):
        for part in slices(batch, 1):
            hashes, first = shingle_hashes(words(part.column(1)), k)
            for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                own = np.unique(hashes[a:b])
                n = len(own)
                if n:
                    sketch = np.arange(n) < sketch_length(n, threshold)
                    ids = part.column(0).slice(i, 1).take(pa.array(np.zeros(n, np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(_as_long(own)), pa.array(np.full(n, n, np.int64)), pa.array(sketch)], names=["item_id", "shingle", "n", "in_sketch"])

    kind = items.schema[item_id].dataType.simpleString()
    return arrow_map(items.select(item_id, text), rows, f"item_id {kind}, shingle long, n long, in_sketch boolean")


def _hits(docs: DataFrame, doc: str, text: str, k: int, keep: Broadcast | None) -> DataFrame:
    """(doc, shingle) for the distinct shingles of each document.

    With ``keep``, documents without any sketch shingle give nothing and the others only
    the shingles that items have.
    """

    def rows(batch: pa.RecordBatch):
        sketch, known = (None, None) if keep is None else keep.value
        for part in slices(batch, 1):
            hashes, first = shingle_hashes(words(part.column(1)), k)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            if known is not None:
                met = np.zeros(part.num_rows, dtype=bool)
                met[owner[_among(hashes, sketch)]] = True
                use = met[owner]
                hashes, owner = hashes[use], owner[use]
                use = _among(hashes, known)
                hashes, owner = hashes[use], owner[use]
            if len(hashes):
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[new])), pa.array(_as_long(hashes[new]))], names=["doc", "shingle"])

    kind = docs.schema[doc].dataType.simpleString()
    return arrow_map(docs.select(doc, text), rows, f"doc {kind}, shingle long")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc, item_id, n_shared, n_item): every document and every item it contains.

    Texts without words contain nothing and are contained in nothing; a text with fewer
    than ``k`` words is one shingle, which only another text of just these words has.
    Rows with the same id count as one text for documents, so ids should be unique;
    null ids are left out of the result.  Items with the same text are found alike.
    Other columns are not read.
    """
    shingles = item_shingles(items.where(F.col(item_id).isNotNull()), item_id, item_text, k, threshold)
    shingles = shingles.dropDuplicates(["item_id", "shingle"])
    some = shingles.select("shingle", "in_sketch").limit(max_broadcast + 1).toArrow()
    keep = None
    if some.num_rows <= max_broadcast:
        every = some.column("shingle").to_numpy().view(np.uint64)
        sketch = every[some.column("in_sketch").to_numpy()]
        keep = docs.sparkSession.sparkContext.broadcast((np.unique(sketch), np.unique(every)))
    hits = _hits(docs.where(F.col(doc_id).isNotNull()), doc_id, text, k, keep)
    if keep is None:  # too many items: candidates come from a join on the sketches
        met = hits.join(shingles.where("in_sketch").select("shingle").distinct(), "shingle", "left_semi").select("doc").distinct()
        hits = hits.join(met, "doc", "left_semi")
    met = hits.join(shingles, "shingle").dropDuplicates(["doc", "item_id", "shingle"])
    counted = met.groupBy("doc", "item_id").agg(F.count("*").alias("n_shared"), F.first("n").alias("n_item"), F.max("in_sketch").alias("candidate"))
    enough = F.ceil(F.round(F.col("n_item") * F.lit(float(threshold)), 9))
    return counted.where(F.col("candidate") & (F.col("n_shared") >= enough)).drop("candidate")


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that contain an item, whatever their id is."""
    whole = of_row(text)
    names = {"id": F.coalesce(of_row(doc_id).cast("string"), F.lit("")), "key": F.xxhash64(whole), "other": F.xxhash64(F.lit(1), whole)}
    rows = as_row(docs).withColumns(names)
    found = contained(rows.select(F.struct(*names).alias("name"), whole.alias("text")), items, "name", "text", item_id, item_text, k, threshold)
    return rows.join(found.select("doc.*").distinct(), list(names), "left_anti").select(f"{ROW}.*")

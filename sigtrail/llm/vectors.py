"""Near copies among embeddings by an exact metric range join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so a cosine bound is a distance bound
r.  Pivots divide the vectors into cells of the nearest pivot.  A vector is copied to
another cell only if a vector of that cell can be within r of it: by the triangle
inequality its distance to that pivot exceeds its distance to its own by 2r at most, and
it is within r of the half-space that is nearer to that pivot.  So each vector meets all
its partners in its home cell, and cells are joined independently.  A large cell is
joined block by block, so no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrail.llm.components import components
from sigtrail.llm.scratch import arrow_map, drop, runs, staged

CELL_ROWS = 2048
"""Vectors of a label that one pivot should have; sets the number of pivots."""
MOST_PIVOTS = 256
"""Pivots that are sent to every task; cells beyond grow and are joined in more blocks."""
BLOCK = 1024


def _units(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, dim, unit, cid): ``unit`` is null for what links with nothing."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, dims = [], []
        for value, name in zip(batch.column(2), batch.column(1)):
            values = value.values
            unit = None
            if values is not None and len(values) and not values.null_count and name.is_valid:
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(x).max()
                if np.isfinite(x).all() and top > 0:
                    x = x / top
                    unit = (x / np.sqrt(x @ x)).tobytes()
            out.append(unit)
            dims.append(len(values) if unit else None)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "unit"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in (vec_id, label)]
    out = arrow_map(vectors.select(vec_id, label, embedding), rows, f"vec_id {kinds[0]}, label {kinds[1]}, dim int, unit binary")
    return out.withColumn("cid", F.when(F.col("unit").isNotNull(), F.unhex(F.md5(F.concat(F.encode(F.col("label").cast("string"), "utf-8"), F.encode(F.lit(":"), "utf-8"), "unit")))))


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector up to MOST_PIVOTS unit vectors, in the order of ids."""
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    wanted = min(MOST_PIVOTS, -(-largest // CELL_ROWS))
    some = classes.select("cid", "dim", "unit").orderBy("cid").limit(4 * MOST_PIVOTS).toArrow()
    pivots: dict[int, list] = {}
    for dim, unit in zip(some.column("dim").to_pylist(), some.column("unit").to_pylist()):
        if len(pivots.setdefault(dim, [])) < wanted:
            pivots[dim].append(np.frombuffer(unit))
    return {dim: np.stack(p) for dim, p in pivots.items()}


def _cells(classes: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    """(label, dim, cell, home, cid, copies, unit): each vector in its home cell and in
    those whose members may be within ``radius``."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = batch.column(1).to_numpy()
        for dim in np.unique(dims):
            own = batch.take(pa.array(np.flatnonzero(dims == dim)))
            x = np.stack([np.frombuffer(u) for u in own.column(4).to_pylist()])
            p = shared.value.get(int(dim))
            if p is None or len(p) < 2:
                at, cell, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
            else:
                square = np.maximum(2 - 2 * (x @ p.T), 0)
                near = square.argmin(axis=1)
                least = square[np.arange(len(x)), near][:, None]
                apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 1e-12))[near]
                inside = (np.sqrt(square) - np.sqrt(least) <= 2 * radius + 1e-9) & ((square - least) / (2 * apart) <= radius + 1e-9)
                inside[np.arange(len(x)), near] = True
                at, cell = np.nonzero(inside)
                home = near[at] == cell
            got = own.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(cell), pa.array(home), got.column(2), got.column(3), got.column(4)], names=["label", "dim", "cell", "home", "cid", "copies", "unit"])

    kind = classes.schema["label"].dataType.simpleString()
    return arrow_map(classes.select("label", "dim", "cid", "copies", "unit"), rows, f"label {kind}, dim int, cell long, home boolean, cid binary, copies long, unit binary")


def _roots(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable number of each of n nodes; row i of ``adjacent`` links
    left[i] with the marked ones of ``right``."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, left, np.where(adjacent, root[right], n).min(axis=1, initial=n))
        np.minimum.at(root, right, np.where(adjacent, root[left][:, None], n).min(axis=0, initial=n))
        root = np.minimum(root, root[root])
        if (root == before).all():
            return root


def _joined(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(cid, links, root): partial numbers of links, and a member of the same component
    for each vector and block; null roots link nothing."""
    sizes = members.groupBy("label", "dim", "cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all"))
    rows = members.join(sizes, ["label", "dim", "cell"])
    for name, size in (("home_blocks", "homes"), ("all_blocks", "all")):
        rows = rows.withColumn(name, F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int"))
    place = F.xxhash64("cid")
    one = rows.where("home").withColumn("a", F.pmod(place, "home_blocks").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)))
    two = rows.withColumn("b", F.pmod(place, "all_blocks").cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)))
    keys = ["label", "dim", "cell", "a", "b"]
    columns = [*keys, "query", "cid", "copies", "unit"]
    dealt = one.withColumn("query", F.lit(True)).select(*columns).union(two.withColumn("query", F.lit(False)).select(*columns))
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 5):
            query = run.column(5).to_numpy(zero_copy_only=False)
            left, right = np.flatnonzero(query), np.flatnonzero(~query)
            if not len(left) or not len(right):
                continue
            ids = np.array(run.column(6).to_pylist(), dtype=object)
            names, number = np.unique(ids, return_inverse=True)
            copies = run.column(7).to_numpy()
            x = np.stack([np.frombuffer(u) for u in run.column(8).to_pylist()])
            adjacent = (x[left] @ x[right].T >= cosine) & (number[left][:, None] != number[right])
            links = adjacent @ copies[right]
            root = _roots(adjacent, number[left], number[right], len(names))
            total = np.zeros(len(names), np.int64)
            np.add.at(total, number[left], links)
            use = np.flatnonzero((root != np.arange(len(names))) | (total > 0))
            if len(use):
                yield pa.RecordBatch.from_arrays([pa.array(names[use].tolist(), pa.binary()), pa.array(total[use]), pa.array(names[root[use]].tolist(), pa.binary())], names=["cid", "links", "root"])

    return dealt.mapInArrow(compare, "cid binary, links long, root binary")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors of equal, non-null label and equal length link when their cosine, in double
    precision, reaches ``cosine``.  Null, empty and zero vectors and those with a null
    or non-finite component have no links and are their own component.  Equal vectors
    are linked with each other and are compared once.  ``component_id`` is the smallest
    id of the component; a null id never names one, and its row isn't kept.
    """
    units = staged(_units(vectors, vec_id, embedding, label))
    classes = staged(units.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("label", "dim", "unit")]))
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    found = staged(_joined(_cells(classes, _pivots(classes), radius), cosine, block))
    labels = components(found.select("cid", "root"), "cid", "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "rep", "copies").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("smallest"))
    by_class = named.join(smallest, "component").join(links, "cid", "left").select("cid", "smallest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    by_class = staged(by_class)
    drop(classes, found)
    out = units.join(by_class, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

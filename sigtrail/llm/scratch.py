"""Stage tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigtrail.session import cut_lineage


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir`` and read back.

    What is read several times is computed once this way, and a lost executor costs a
    re-read.  ``drop`` deletes the files when nothing lazy needs them any more.
    """
    return cut_lineage(df)


def drop(*frames: DataFrame) -> None:
    """Delete the files of staged frames that no later result reads."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  Python workers that see the same file system then find this
    package; elsewhere it is shipped with ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROW = "_whole_row_"
"""One column for all columns of a table, so that none can clash with a helper's name."""


def as_row(docs: DataFrame) -> DataFrame:
    """``docs`` as the one column ``ROW``."""
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias(ROW))


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def of_row(name: str) -> Column:
    """A column of ``ROW``."""
    return F.col(ROW)[name]


def from_row(docs: DataFrame, *without: str) -> list[Column]:
    """The columns of the table behind ``ROW``, but for some."""
    return [of_row(c).alias(c) for c in docs.columns if c not in without]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice take about ``max_bytes``; one longer
    text is a slice of its own.  Bounds the memory of whatever is computed per byte."""
    lengths = batch.column(column)
    start, used = 0, 0
    for i, size in enumerate(pc.binary_length(lengths).to_pylist()):
        size = size or 0
        if used + size > max_bytes and i > start:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += size
    if batch.num_rows > start:
        yield batch.slice(start)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows with equal first ``keys`` columns together, from sorted batches.

    Holds one run at a time, so runs must be of bounded size.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for i in range(keys):
            column = batch.column(i).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
            new[0] |= not held or held[-1].column(i)[held[-1].num_rows - 1].as_py() != column[0]
        cuts = np.flatnonzero(new)
        edges = [0, *cuts[cuts > 0], batch.num_rows]
        if new[0] and held:
            yield _joined(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:]):
            if a and held:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

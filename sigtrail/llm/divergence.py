"""Divergence of sources within a language, from exact sparse document vectors.

``CountVectorizer`` with a least document frequency and the largest integer as size of
its vocabulary turns documents into sparse vectors of counts.  A mark before each term
tells its language, so one fit learns the vocabularies of many languages and counts
frequencies per language.  Vectors are added up by (language, source) as ``Summarizer`` would, but
entry by entry: its buffers are dense.  Sources are then compared over the terms that
any of them has; all others differ by what a term without occurrences weighs.

A vocabulary passes through the driver.  A kept term occurs in ``min_docs`` documents, so
the number of occurrences bounds that of kept terms.  Where this bound is beyond
``SLICE_TERMS``, distinct terms are estimated and dealt by hash into slices with a fit
each.  A slice is written apart, so a token is read by one fit whatever their number.

All arithmetic is exact: counts are whole doubles below 2^53, shares whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.llm.scratch import arrow_map, slices, staged
from sigtrail.llm.words import text_bytes
from sigtrail.plans.ordered import position
from sigtrail.session import is_small, scratch_path

SCALE = 1_000_000_000
SLICE_TERMS = 1 << 23
"""Terms that a fit may keep, by a bound on them; a vocabulary is under 1 GB then."""
BLOCK = 64
"""Sources of a language that one comparison holds on each side."""
_MARKS = 63
"""Languages of one fit: a byte below the letters tells them apart."""
_TERM, _LOW = np.zeros(256, dtype=bool), np.arange(256, dtype=np.uint8)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_LOW[0x41:0x5B] += 0x20


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, part, mark, text) with the text's terms in its place: maximal runs of
    letters of ASCII and of bytes above it, A-Z lower-cased, each behind its mark."""
    for batch in batches:
        for part in slices(batch, 3, 8 << 20):
            raw, offsets = text_bytes(pc.binary_join_element_wise("", part.column(3), " "))
            inside = _TERM[raw]
            start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1  # each text begins with a blank
            ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
            low = _LOW[raw]
            first = np.searchsorted(start, offsets)
            low[start - 1] = np.repeat(part.column(2).to_numpy().astype(np.uint8), np.diff(first))
            inside[start - 1] = True
            size = np.append(0, np.cumsum(ends - start + 1)).astype(np.int32)
            terms = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(size), pa.py_buffer(low[inside])])
            listed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), terms)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), listed], names=["group", "part", "terms"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, indices, values) of vectors, added up entry by entry within a batch."""
    for batch in batches:
        index, value = batch.column(1), batch.column(2)
        group = np.repeat(batch.column(0).to_numpy().astype(np.int64) << 32, index.value_lengths().to_numpy())
        found, at = np.unique(group | index.flatten().to_numpy(), return_inverse=True)
        n = np.bincount(at, weights=value.flatten().to_numpy(), minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array((found >> 32).astype(np.int32)), pa.array((found & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], names=["group", "index", "n"])


def _fitted(documents: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(group, index, n) of one slice, and its vocabulary (index, mark, term)."""
    spark = documents.sparkSession
    # A term of its own keeps the vocabulary from being empty, which is an error.
    padding = spark.range(min_docs).select(F.array(F.lit("\0")).alias("terms"))
    counter = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=(1 << 31) - 1)
    model = counter.fit(documents.select("terms").unionByName(padding))
    words = model.vocabulary
    marked = pa.table({"index": pa.array(range(len(words)), pa.int32()), "mark": pa.array([ord(w[0]) for w in words], pa.int32()), "term": pa.array([w[1:] for w in words], pa.string())})
    vocabulary = staged(spark.createDataFrame(marked)).where("mark > 0")
    vector = F.unwrap_udt("vector")
    entries = model.transform(documents).select("group", vector["indices"].alias("indices"), vector["values"].alias("values"))
    return entries.mapInArrow(_sums, "group int, index int, n long").groupBy("group", "index").agg(F.sum("n").alias("n")), vocabulary


def group_counts(docs: DataFrame, groups: DataFrame, min_docs: int, slice_terms: int = SLICE_TERMS) -> tuple[DataFrame, DataFrame]:
    """Occurrences (group, term, n) above 0 of kept terms, and the kept (lang, term).

    ``groups`` numbers each (lang, source).  Languages with too few documents to keep a
    term aren't read.
    """
    spark = docs.sparkSession
    large = groups.groupBy("lang").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang")
    number = position(large, [], ["lang"], "number")
    marks = staged(number.select("lang", F.call_function("div", F.col("number"), F.lit(_MARKS)).cast("int").alias("part"), (F.col("number") % _MARKS + 1).cast("int").alias("mark")))
    marked = staged(groups.join(marks, "lang").select("lang", "source", "group", "part", "mark"))
    numbered = _beside(docs, marked, ["lang", "source"]).select("group", "part", "mark", "text")
    tokens = staged(numbered.mapInArrow(_terms, "group int, part int, terms array<string>"))
    batches, total = tokens.agg(F.coalesce(F.max("part") + 1, F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    slices_ = 1
    if total // min_docs > slice_terms:  # so many terms may be kept
        distinct = tokens.select(F.explode("terms").alias("t")).agg(F.approx_count_distinct("t", 0.02)).first()[0]
        slices_ = -(-distinct // slice_terms) or 1
    parts = [tokens]
    if slices_ * batches > 1:
        path = scratch_path(spark, "slices")
        cut = F.transform(F.sequence(F.lit(0), F.lit(slices_ - 1)), lambda i: F.struct(i.alias("slice"), F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(slices_)) == i).alias("terms")))
        tokens.select("group", "part", F.inline(cut)).where(F.size("terms") > 0).write.partitionBy("part", "slice").parquet(path)
        cells = spark.read.schema("group int, terms array<string>, part int, slice int").parquet(path)
        parts = [cells.where((F.col("part") == i) & (F.col("slice") == j)) for i in range(batches) for j in range(slices_)]
    counts, kept = [], []
    for i, part in enumerate(parts):
        summed, vocabulary = _fitted(part, min_docs)
        counts.append(summed.join(vocabulary.drop("mark"), "index").select("group", "term", "n"))
        kept.append(_beside(vocabulary, marks.where(F.col("part") == i // slices_), ["mark"]).select("lang", "term"))
    return staged(_together(counts)), _together(kept)


def _together(frames: list[DataFrame]) -> DataFrame:
    first, *others = frames
    for df in others:
        first = first.unionByName(df)
    return first


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * kept)), in decimals as products are long."""
    scaled = (n.cast("decimal(20,0)") + 5) * F.lit(SCALE).cast("decimal(10,0)")
    return (1 + F.call_function("div", scaled, (total + 5 * kept).cast("decimal(20,0)"))).cast("long")


def _beside(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Joined with a frame that is sent to all tasks if it has few rows."""
    return df.join(F.broadcast(small) if is_small(small) else small, keys)


def _distances(batch: pa.RecordBatch, block: int):
    """Sums of differences of one batch of terms, for all pairs of places of a cell."""
    lang, low, high = (batch.column(i) for i in range(3))
    cells: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(lang.to_pylist(), low.to_pylist(), high.to_pylist())):
        cells.setdefault(key, []).append(i)
    found = {k: [] for k in ("lang", "a", "b", "value", "seen")}
    for (name, lo, hi), rows in cells.items():
        part = batch.take(pa.array(rows))
        zero = np.array(part.column("zeros")[0].as_py(), dtype=np.int64)
        place = np.array(part.column("places")[0].as_py(), dtype=np.int64)
        have = part.column("have")
        at = np.searchsorted(place, have.flatten().field("pos").to_numpy())
        shares = np.tile(zero, (len(rows), 1))
        shares[np.repeat(np.arange(len(rows)), have.value_lengths().to_numpy()), at] = have.flatten().field("p").to_numpy()
        side = place // block
        for i in np.flatnonzero(side == lo):
            others = np.flatnonzero((side == hi) & (place > place[i]))
            if len(others):
                found["lang"] += [name] * len(others)
                found["a"] += [int(place[i])] * len(others)
                found["b"] += place[others].tolist()
                found["value"] += np.abs(shares[:, others] - shares[:, [i]]).sum(axis=0).tolist()
                found["seen"] += [len(rows)] * len(others)
    yield pa.RecordBatch.from_arrays([pa.array(found["lang"], pa.string()), *(pa.array(found[k], pa.int64()) for k in ("a", "b", "value", "seen"))], names=list(found))


def _pairs(entries: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(lang, source, item, value): the difference of each source from each other one."""
    blocks = F.call_function("div", F.col("n_sources") - 1, F.lit(block))
    own = F.call_function("div", F.col("pos"), F.lit(block))
    met = F.explode(F.sequence(F.lit(0).cast("long"), blocks))

    def celled(df: DataFrame) -> DataFrame:
        return df.select("*", met.alias("_other"), own.alias("_own")).withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")})

    listed = F.sort_array(F.collect_list(F.struct("pos", "zero")))
    cells = celled(groups).groupBy("lang", "lo", "hi").agg(listed.alias("all")).select("lang", "lo", "hi", F.col("all.pos").alias("places"), F.col("all.zero").alias("zeros"))
    by_term = celled(entries).groupBy("lang", "lo", "hi", "term").agg(F.collect_list(F.struct("pos", "p")).alias("have"))
    rows = _beside(by_term, cells, ["lang", "lo", "hi"]).select("lang", "lo", "hi", "have", "places", "zeros")
    sums = arrow_map(rows, lambda batch: _distances(batch, block), "lang string, a long, b long, value long, seen long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    later = groups.where("pos + 1 < n_sources").select("lang", F.col("source").alias("first"), F.col("pos").alias("a"), F.col("zero").alias("zero_a"), "kept", F.explode(F.sequence(F.col("pos") + 1, F.col("n_sources") - 1)).alias("b"))
    both = _beside(later, groups.select("lang", F.col("pos").alias("b"), F.col("source").alias("second"), F.col("zero").alias("zero_b")), ["lang", "b"]).join(sums, ["lang", "a", "b"], "left")
    unseen = F.when(F.col("kept") > 0, (F.col("kept") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("zero_a") - F.col("zero_b"))).otherwise(F.lit(0))
    valued = both.withColumn("value", F.coalesce("value", F.lit(0)) + unseen)
    ways = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("first", "second"), ("second", "first"))])
    return valued.select("lang", F.inline(ways), "value")


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, slice_terms: int = SLICE_TERMS, block: int = BLOCK, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every (language, source).

    A kept term weighs ``1 + floor(10^9 (n + 5) / (N + 5 V))`` in a source, with n its
    occurrences there, N those of all V kept terms of the language.  Part ``pair``: the
    summed differences from each other source of the language, all ranks, 0 without kept
    terms.  Part ``term``: the ``top`` terms that the source has and that weigh more in
    it than in the whole language, with the difference.  Ties are ordered by the item.

    Nulls in the three columns read are empty, and so are names of their own; repeated
    rows count each; a source without terms is compared like any other, a language with
    one source has no pairs; no rows give no rows.  Further columns are not read.
    """
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    present = plain.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    pairs = staged(position(present, [], ["lang", "source"], "group").withColumn("group", F.col("group").cast("int")))
    counts, kept = group_counts(plain, pairs, min_docs, slice_terms)
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    in_lang = Window.partitionBy("lang")
    groups = pairs.drop("docs").join(totals, "group", "left").join(vocabulary, "lang", "left").fillna(0, ["total", "kept"])
    zero = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0))
    groups = staged(
        groups.withColumns({
            "lang_total": F.sum("total").over(in_lang),
            "n_sources": F.count("*").over(in_lang),
            "pos": (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long"),
            "zero": zero,
        })
    )
    entries = _beside(counts, groups, ["group"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))
    everywhere = F.sum("n").over(Window.partitionBy("lang", "term"))
    more = entries.withColumn("value", F.col("p") - _share(everywhere, F.col("lang_total"), F.col("kept"))).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pair = _pairs(entries, groups, block).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pair.unionByName(best)

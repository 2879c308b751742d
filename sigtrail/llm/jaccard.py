"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Shingles are ordered from rare to common.  Two sets of similarity t share at least L
shingles within their L-prefixes, the first n - ceil(t n) + L of each.  Every document
chooses its own L: a longer prefix visits more postings, but a pair must then meet L
times before it is worth verifying.  The choice weighs both by the shingles' estimated
frequencies, and a pair needs the smaller L of its two sides.

Frequencies come from a table of hashed counters of fixed size.  They only guide the
order and L, so an estimate that is off costs time and never a link.

Documents with the same shingle set are one class; only classes are compared.  Classes
that meet on a shingle are first compared with the most typical of them, and what that
links needs no further comparison.  What is left is compared in blocks of bounded size,
where a parity sketch of each set (the number of positions in which two sketches differ
never exceeds the number of shingles that the sets don't share) drops most pairs, and the
rest is verified on the sets.  A very frequent shingle is spread over many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtrail.llm.components import components
from sigtrail.llm.scratch import ROW, arrow_map, as_row, drop, of_row, runs, slices, staged
from sigtrail.llm.words import mix, shingle_sets

COUNTER_BITS = 18
FILTER_BITS, FILTER_HASHES = 1 << 24, 3
LEAST_BITS = 512
BLOCK = 512
MOST_MATCHES = 8
VERIFY_COST = 20.0
"""Postings that may be visited in the time that verifying a pair takes."""


class Similarity(NamedTuple):
    """``intersection / union >= numerator / denominator`` over ``k``-word shingles."""

    k: int = 5
    numerator: int = 80
    denominator: int = 100

    def must_share(self, n: int) -> int:
        return -(-self.numerator * n // self.denominator)

    def close_sizes(self, a: Column, b: Column) -> Column:
        return (self.denominator * F.least(a, b)) >= (self.numerator * F.greatest(a, b))

    def may_differ(self, differ, sizes):
        """Whether sets of these sizes in total may differ in so many shingles."""
        return (self.denominator + self.numerator) * differ <= (self.denominator - self.numerator) * sizes

    def holds(self, shared: Column, sizes: Column) -> Column:
        return (self.denominator + self.numerator) * shared >= self.numerator * sizes


def _counters(docs: DataFrame, text: str, like: Similarity) -> np.ndarray:
    """Documents per hashed shingle: 2 ** COUNTER_BITS counters whatever the input."""

    def count(batches):
        sums = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for own in shingle_sets(part.column(0), like.k):
                    np.add.at(sums, (own >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        has = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(sums[has])], names=["at", "n"])

    got = docs.select(text).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(1 << COUNTER_BITS, np.int64)
    sums[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return sums


def set_id(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    one, two = mix(own ^ np.uint64(0x5851F42D4C957F2D)), mix(own + np.uint64(0x14057B7EF767814F))
    return np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)], dtype=">u8").tobytes()


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each position; as many positions as
    shingles, rounded up to a power of two and at least LEAST_BITS, so that sets of any
    size can be told apart."""
    width = max(LEAST_BITS, 1 << (len(own) - 1).bit_length() if len(own) else 0)
    at = (mix(own + np.uint64(0x2545F4914F6CDD1D)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).view(np.uint64)


def fold(marks: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) as those with fewer positions."""
    while marks.shape[-1] > words:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] ^ marks[..., half:]
    return marks


def may_link(one: list[bytes], two: list[bytes], sizes: np.ndarray, like: Similarity) -> np.ndarray:
    """For pairs of sketches of sets of so many shingles in total, whether they may be
    similar.  Pairs of equal widths are compared at once."""
    out = np.zeros(len(one), dtype=bool)
    widths = np.array([(len(a), len(b)) for a, b in zip(one, two)]).reshape(-1, 2)
    for wide in np.unique(widths, axis=0):
        at = np.flatnonzero((widths == wide).all(axis=1))
        step = max(1, (1 << 22) // int(wide.max()))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            a = np.frombuffer(b"".join(one[i] for i in part), np.uint64).reshape(len(part), -1)
            b = np.frombuffer(b"".join(two[i] for i in part), np.uint64).reshape(len(part), -1)
            words = int(wide.min()) // 8
            differ = np.bitwise_count(fold(a, words) ^ fold(b, words)).sum(axis=1, dtype=np.int64)
            out[part] = like.may_differ(differ, sizes[part])
    return out


def prefix(own: np.ndarray, frequency: np.ndarray, noise: float, like: Similarity) -> tuple[np.ndarray, int]:
    """The L-prefix of a set, with the L of least estimated cost."""
    n = len(own)
    order = np.lexsort((own, frequency))
    base = n - like.must_share(n)
    visits = np.cumsum(np.maximum(frequency[order] - noise, 0.0))
    matches = np.arange(1, max(1, min(MOST_MATCHES, like.must_share(n))) + 1)
    cost = visits[base + matches - 1] * (1 + VERIFY_COST / matches)
    best = int(matches[np.argmin(cost)])
    return own[order[: base + best]], best


def _profiles(docs: DataFrame, doc_id: str, text: str, like: Similarity) -> DataFrame:
    """(doc_id, n, sid, matches, prefix, mark) of every document."""
    counters = _counters(docs, text, like)
    noise = float(counters.mean())
    shared = docs.sparkSession.sparkContext.broadcast(counters.astype(np.int32 if counters.max(initial=0) < 1 << 31 else np.int64))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for part in slices(batch, 1):
            sets = shingle_sets(part.column(1), like.k)
            chosen = [prefix(s, frequency[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], noise, like) if len(s) else (s, 0) for s in sets]
            columns = [
                part.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_id(s) for s in sets], pa.binary()),
                pa.array([m for _, m in chosen], pa.int32()),
                pa.array([p.view(np.int64) for p, _ in chosen], pa.list_(pa.int64())),
                pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sid", "matches", "prefix", "mark"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return arrow_map(docs.select(doc_id, text), rows, f"doc_id {kind}, n long, sid binary, matches int, prefix array<long>, mark binary")


def _filter_bits(wanted: DataFrame, key: Column) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits over ``key``, whatever the number of rows."""
    places = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)]
    bit = wanted.select(F.explode(F.array(*places)).alias("at"))
    words = bit.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little")


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, like: Similarity) -> DataFrame:
    """(cls, shingles) of the wanted classes (cls, rep, sid), computed anew from the texts.

    A Bloom filter of the documents drops most others where they are read, so that no
    texts are shuffled; what passes by chance goes by its sid.
    """
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter_bits(wanted, F.col("rep"))))
    places = [F.pmod(F.xxhash64(F.col(doc_id), F.lit(i)), F.lit(FILTER_BITS)).alias(f"_p{i}") for i in range(FILTER_HASHES)]
    texts = docs.select(F.col(text).alias("_text"), *places)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        packed = bits.value
        passes = np.ones(batch.num_rows, dtype=bool)
        for i in range(FILTER_HASHES):
            at = batch.column(1 + i).to_numpy()
            passes &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        for part in slices(batch.take(pa.array(np.flatnonzero(passes))), 0):
            sets = shingle_sets(part.column(0), like.k)
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "shingles"])

    found = arrow_map(texts, rows, "sid binary, shingles array<long>")
    return found.join(wanted.select("sid", "cls"), "sid").drop("sid").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, like: Similarity) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by exact counts."""
    pairs = staged(pairs)
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = staged(_sets(docs, staged(classes.join(ends, "cls", "left_semi").select("cls", "rep", "sid")), doc_id, text, like))
    one = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    links = staged(pairs.join(one, "a").join(two, "b").where(like.holds(shared, F.size("of_a") + F.size("of_b"))).select("a", "b"))
    drop(pairs, sets)
    return links


def _pivot_pairs(met: DataFrame, classes: DataFrame, like: Similarity) -> DataFrame:
    """Every class with the most typical class (most shared prefix shingles, then most
    copies) of each shingle that it shares: at most one pair per row of ``met``."""
    typical = met.groupBy("cls").agg(F.count("*").alias("meets")).join(classes.select("cls", "copies"), "cls")
    pivots = met.join(typical, "cls").groupBy("shingle").agg(F.max(F.struct("meets", "copies", "cls")).alias("top")).select("shingle", F.col("top.cls").alias("b"))
    pairs = met.join(pivots, "shingle").where("cls <> b").select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()
    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("mark").alias("mark_a"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("mark").alias("mark_b"))
    sizes = pairs.join(one.drop("mark_a"), "a").join(two.drop("mark_b"), "b").where(like.close_sizes(F.col("na"), F.col("nb")))
    near = sizes.join(one.drop("na"), "a").join(two.drop("nb"), "b").select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), "mark_a", "mark_b")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = may_link(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(2).to_numpy(), like)
        return batch.select([0, 1]).filter(pa.array(keep))

    return arrow_map(near, rows, "a long, b long")


def _block_pairs(met: DataFrame, classes: DataFrame, labels: DataFrame, like: Similarity, block: int) -> DataFrame:
    """(a, b) of classes in different components that meet often enough to be verified."""
    named = met.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high").select("shingle", "size")
    rows = named.join(mixed, "shingle").join(classes.select("cls", "n", "matches", "mark"), "cls")
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    rows = rows.select(*keys, "own", "cls", "component", "n", "matches", "mark")
    dealt = rows.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 3):
            own, cls, component, n, matches = (run.column(i).to_numpy() for i in range(3, 8))
            pairs = (component[:, None] != component) & (like.denominator * np.minimum(n[:, None], n) >= like.numerator * np.maximum(n[:, None], n))
            if run.column(1)[0].as_py() != run.column(2)[0].as_py():
                pairs &= own[:, None] != own  # pairs of one block meet elsewhere
            x, y = np.nonzero(np.triu(pairs, 1))
            if len(x):
                marks = np.array(run.column(8).to_pylist(), dtype=object)
                keep = may_link(marks[x].tolist(), marks[y].tolist(), n[x] + n[y], like)
                x, y = x[keep], y[keep]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(cls[x]), pa.array(cls[y]), pa.array(np.minimum(matches[x], matches[y]))], names=["x", "y", "need"])

    met_pairs = dealt.mapInArrow(compare, "x long, y long, need int")
    met_pairs = met_pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "need")
    return met_pairs.groupBy("a", "b").agg(F.count("*").alias("times"), F.first("need").alias("need")).where("times >= need").select("a", "b")


def near_classes(docs: DataFrame, like: Similarity, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; with ``links`` also
    (class_id, n_links).

    ``component_id`` is the smallest ``doc_id`` that links reach, itself included.  A
    text without words has no shingles and is linked with nothing; null is the empty
    text.  Rows with a null id can link others and belong to their component, but never
    name it; a component of such rows only has a null name.  Other columns of ``docs``
    aren't read.

    Components need no links inside what is already one component, so those are not
    sought.  With ``links`` all pairs of classes are met and verified, in a large group of
    differing near copies as many as it has: ``n_links`` counts the other rows that a row
    is similar to, its copies among them, and ``class_id`` is the smallest ``doc_id`` of
    the rows with its shingle set (of a text without shingles, its own).
    """
    profiles = staged(_profiles(docs, doc_id, text, like))
    ids = staged(profiles.select("doc_id", "n", "sid"))
    firsts = [F.first(c).alias(c) for c in ("n", "matches", "prefix", "mark")]
    grouped = profiles.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *firsts)
    classes = staged(grouped.withColumn("cls", F.monotonically_increasing_id()))  # fixed by being written
    drop(profiles)
    rows = classes.select("cls", F.explode("prefix").alias("shingle"))
    several = rows.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle")
    met = staged(rows.join(several, "shingle"))
    if links:
        none = docs.sparkSession.createDataFrame([], "node long, component long")
        found = _verified(_block_pairs(met, classes, none, like, block), classes, docs, doc_id, text, like)
        labels = components(found, "a", "b")
    else:
        found = _verified(_pivot_pairs(met, classes, like), classes, docs, doc_id, text, like)
        first_labels = components(found, "a", "b")
        more = _verified(_block_pairs(met, classes, first_labels, like, block), classes, docs, doc_id, text, like)
        labels = components(found.union(more), "a", "b")
        drop(more)
    named = classes.select("cls", "sid", "rep", "copies").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = named.join(smallest, "component")
    if links:
        ends = found.select(F.col("a").alias("cls"), F.col("b").alias("near")).union(found.select("b", "a"))
        near = ends.join(classes.select(F.col("cls").alias("near"), F.col("copies").alias("others")), "near").groupBy("cls").agg(F.sum("others").alias("others"))
        by_class = by_class.join(near, "cls", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    extra = ["rep", "n_links"] if links else []
    by_class = staged(by_class.select("sid", "component_id", *extra))
    drop(classes, met, found)
    out = ids.join(by_class, "sid", "left")
    own = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id"))
    extra = [own("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("component_id").alias("component_id"), *extra)


def keep_first(docs: DataFrame, like: Similarity, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows without id come after all others.  Rows that share an id are ordered by a hash
    of their texts; of rows equal in id and text one stays, whichever it is, unless their
    text has no words.
    """
    whole = F.coalesce(of_row(text), F.lit(""))
    key = F.struct(of_row(doc_id).isNull().alias("unnamed"), of_row(doc_id).alias("id"), F.xxhash64(whole).alias("digest"), F.xxhash64(F.lit(1), whole).alias("more"))
    rows = as_row(docs).withColumn("key", key)
    named = staged(near_classes(rows.select(F.col("key").alias("doc_id"), of_row(text).alias("text")), like))
    rest = named.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct()
    kept = rows.join(rest, "key", "left_anti")
    repeated = named.where("n_shingles > 0 AND doc_id = component_id").groupBy(F.col("doc_id").alias("key")).count().where("count > 1").select("key")
    if repeated.limit(1).count():
        once = kept.join(repeated, "key", "left_semi").dropDuplicates(["key"])
        kept = kept.join(repeated, "key", "left_anti").unionByName(once)
    return kept.select(f"{ROW}.*")

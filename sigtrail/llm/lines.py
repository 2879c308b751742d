"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are one edit apart if and only if one is the other without a character, or
both become equal when the character at the same place goes.  So a line emits itself and
its variants with one character deleted, as hashed keys with the deleted place; lines are
joined on equal keys, and the edit distance of what meets is verified.

One edit leaves the front half or the back half of a line as it is.  So a line emits its
variants once for each end that it shares with another line, with all deletions beside
that end; a line that shares none can't have a partner and emits none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.llm.scratch import as_row, drop, from_row, of_row, staged
from sigtrail.plans.stages import bind
from sigtrail.session import is_small

LEAST_CHARS = 16
"""Lines shorter than this are only dropped if they are equal to an earlier one."""


def _end_size(n: str, which: str) -> str:
    """Characters of an end: half a line, rounded down to whole eights.  A line and one
    that is a character longer mostly have ends of one size; where they don't, the longer
    one has those of the shorter one's size too (``which`` 2 and 3)."""
    return f"(({n} - {which} div 2) div 16 * 8)"


def _ends(line: str, n: str, least: int) -> Column:
    """Hashed front (0, 2) and back (1, 3) ends of a line of ``n`` characters, of which
    one edit leaves one intact."""
    keys = [F.expr(f"xxhash64({w % 2}, {_end_size(n, w)}, {'right' if w % 2 else 'left'}({line}, {_end_size(n, w)}))") for w in range(4)]
    return F.when((F.col(n) % 16 == 0) & (F.col(n) > least), F.array(*keys)).otherwise(F.array(*keys[:2]))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, version, pos, line) of all lines that aren't blank; ``version`` tells rows
    with the same id apart."""
    lines = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    return lines.where(F.trim("line") != "")


def _spelled(docs: DataFrame, firsts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(name, line, ord, shared) of the distinct lines that share an end with another
    one; ``ord`` grows in the order of their first places."""
    ends = firsts.select("name", F.posexplode("ends").alias("which", "end"))
    shared = ends.groupBy("end").count().where("count > 1").select("end")
    suspects = ends.join(shared, "end", "left_semi").groupBy("name").agg(F.collect_list(F.struct("which", "end")).alias("shared"))
    places = staged(firsts.join(suspects, "name").select("name", "first", "shared"))
    where = places.select("name", "first", "shared", F.col("first.doc").alias("_doc"), F.col("first.version").alias("_version"), F.col("first.pos").alias("_pos"))
    at = F.col("doc").eqNullSafe(F.col("_doc")) & F.col("version").eqNullSafe(F.col("_version")) & (F.col("pos") == F.col("_pos"))
    found = _lines(docs, doc_id, text).join(F.broadcast(where) if is_small(places) else where, at)
    found = found.select("name", "first", "line", "shared").dropDuplicates(["name"])
    ordered = staged(found.repartitionByRange("first").sortWithinPartitions("first").select("name", "line", "shared", F.monotonically_increasing_id().alias("ord")))
    drop(places)
    return ordered


def _near_repeats(docs: DataFrame, firsts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(name) of distinct lines that have an earlier line one edit away."""
    spelled = _spelled(docs, firsts, doc_id, text)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = spelled.repartition(tasks).select("ord", "line", F.char_length("line").alias("n"), F.inline("shared"))
    # What is left of a line beside an end that it shares: there the edit must be.
    size = _end_size("n", "which")
    rest = F.expr(f"if(which % 2 = 0, substring(line, {size} + 1), left(line, n - {size}))")
    each = bind(each, rest=rest)
    without = "xxhash64(end, concat(substring(rest, 1, i - 1), substring(rest, i + 1)))"
    variants = f"transform(sequence(1, char_length(rest)), i -> struct(i as place, {without} as key))"
    emitted = each.select("ord", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("place"), F.xxhash64("end", "rest").alias("key"))), F.expr(variants))).alias("v"))
    emitted = emitted.select("ord", F.col("v.place").alias("place"), F.col("v.key").alias("key"))
    # Lines with the same variant are few: each is the variant and one character more.
    # At the same place they are one edit apart, and so are they all from the variant
    # itself (place 0), so the earliest of a place stands for it.
    same, key = Window.partitionBy("key", "place"), Window.partitionBy("key")
    whole = F.min(F.when(F.col("place") == 0, F.col("ord"))).over(key)
    longer = F.min(F.when(F.col("place") > 0, F.col("ord"))).over(key)
    met = emitted.select("ord", F.array(F.min("ord").over(same), F.when(F.col("place") == 0, longer).otherwise(whole)).alias("partners"))
    partners = met.select("ord", F.explode("partners").alias("partner")).where("partner < ord").distinct()
    texts = spelled.select("ord", "line", "name")
    pairs = partners.join(texts, "ord").join(spelled.select(F.col("ord").alias("partner"), F.col("line").alias("earlier")), "partner")
    gone = staged(pairs.where(F.levenshtein("line", "earlier", 1) == 1).select("name").distinct())
    drop(spelled)
    return gone


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, ``n_lines`` and ``n_kept``.

    A line goes when an earlier line, kept or not, is equal to it or - if both have
    ``least_chars`` code points or more - at most one insertion, deletion or
    substitution away.  Earlier means a smaller id, then a smaller place in the text;
    null ids come last, and texts of the same id are ordered by a hash.  Identical rows
    stand at one place and keep the same lines.  Blank lines always stay, so empty
    texts stay empty; null stays null and has no lines.  Columns of ``docs`` that are
    named like new ones are replaced.  A line of n characters has n variants of n
    characters, so a line that has a likely partner costs its length squared.
    """
    named = _lines(docs, doc_id, text).withColumn("n", F.char_length("line"))
    named = staged(named.select("doc", "version", "pos", F.unhex(F.md5("line")).alias("name"), F.when(F.col("n") >= least_chars, _ends("line", "n", least_chars)).alias("ends")))
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "version", "pos")
    firsts = staged(named.groupBy("name").agg(F.min(place).alias("first"), F.first("ends").alias("ends")))
    gone = _near_repeats(docs, firsts, doc_id, text)
    kept = firsts.select("name", "first").join(gone.withColumn("gone", F.lit(True)), "name", "left").select("name", F.when(F.col("gone").isNull(), F.col("first")).alias("first"))
    goes = named.select("doc", "version", "pos", "name").join(kept, "name").where(~F.coalesce(place == F.col("first"), F.lit(False)))
    dropped = staged(goes.groupBy("doc", "version").agg(F.array_sort(F.collect_set("pos")).alias("_gone")))
    drop(named, firsts, gone)
    own = as_row(docs).withColumns({"doc": of_row(doc_id), "version": F.xxhash64(of_row(text))})
    found = dropped.withColumnsRenamed({"doc": "_doc", "version": "_version"})
    own = own.join(found, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")), "left")
    whole = of_row(text)
    n_lines = F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    own = own.withColumn("n_lines", F.coalesce(n_lines, F.lit(0)).cast("long"))
    own = own.withColumn("n_kept", F.col("n_lines") - F.coalesce(F.size("_gone"), F.lit(0)))
    # Between two lines that go lies a run that stays: the text is cut into those runs.
    cut = bind(own, _parts=F.when(F.col("_gone").isNotNull(), F.split(whole, "\n", -1)))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_gone")),
        lambda i: F.slice("_parts", F.coalesce(F.get("_gone", i - 1), F.lit(-1)) + 2, F.coalesce(F.get("_gone", i), F.size("_parts")) - F.coalesce(F.get("_gone", i - 1), F.lit(-1)) - 1),
    )
    left = F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(F.flatten(runs), "\n")).alias(text)
    columns = zip((c for c in docs.columns if c not in ("n_lines", "n_kept")), from_row(docs, "n_lines", "n_kept"))
    return cut.select(*[left if name == text else c for name, c in columns], "n_lines", "n_kept")

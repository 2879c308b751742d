"""Interaction audit of document filters by exact constrained least squares.

A filter is a condition under which it removes a document.  The documents that a set of
filters (a coalition) removes are those that fail at least one of them, so a table with
one row for each pattern of failures, counted once over all documents, gives what every
coalition removes, and differences of coalitions give what every step of every order does.

Shapley values are the efficiency-constrained solution of weighted least squares over
all coalitions: with the Shapley kernel as weights, the best additive model whose sum is
what all filters remove together.  The normal equations with their Lagrange row don't
depend on the data.  They are inverted in rationals once and applied to each part's
right-hand side in integers, so the values are exact.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.plans.stages import bind

MOST_FILTERS = 6
"""64 coalitions and 720 orders; what is kept per part grows with both."""
_SPREAD = 1024
"""Parts into which rows without id are dealt where ids are joined."""


def kernel(n: int) -> list[Fraction]:
    """Weight of a coalition of s filters, for s from 0 to n; the empty and the full one
    are held exactly and weigh nothing here."""
    inner = [Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)]
    return [Fraction(0), *inner, Fraction(0)]


def inverse(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan elimination in rationals."""
    n = len(rows)
    work = [[*map(Fraction, row), *(Fraction(i == j) for j in range(n))] for i, row in enumerate(rows)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if work[r][i])
        work[i], work[pivot] = work[pivot], work[i]
        work[i] = [x / work[i][i] for x in work[i]]
        for r in range(n):
            if r != i and work[r][i]:
                work[r] = [x - work[r][i] * y for x, y in zip(work[r], work[i])]
    return [row[n:] for row in work]


def normal_equations(n: int) -> list[list[Fraction]]:
    """Sum of weight * z z' over all coalitions z, bordered by the efficiency row."""
    weights = kernel(n)
    rows = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    for coalition in range(1 << n):
        inside = [i for i in range(n) if coalition >> i & 1]
        for i in inside:
            for j in inside:
                rows[i][j] += weights[len(inside)]
    for i in range(n):
        rows[i][n] = rows[n][i] = Fraction(1)
    return rows


def shapley_columns(removed: Column, n: int) -> list[Column]:
    """n! times the Shapley value of each filter, from the array of what coalitions
    remove (coalition i at place i, a bit for each filter)."""
    weights = kernel(n)
    scale = lcm(*(w.denominator for w in weights))
    solved = inverse(normal_equations(n))
    whole = lcm(*(x.denominator for row in solved for x in row)) * scale

    def weighted(i: int) -> Column:
        terms = [F.get(removed, F.lit(c)) * F.lit(int(weights[c.bit_count()] * scale)) for c in range((1 << n) - 1) if c >> i & 1]
        return sum(terms, F.lit(0).cast("long"))

    right = [*(weighted(i) for i in range(n)), F.get(removed, F.lit((1 << n) - 1)) * F.lit(scale)]
    values = []
    for i in range(n):
        total = sum((b * F.lit(int(x * whole / scale)) for b, x in zip(right, solved[i])), F.lit(0).cast("long"))
        values.append(F.call_function("div", total * F.lit(factorial(n)), F.lit(whole)))
    return values


def failures(docs: DataFrame, conditions: Mapping[str, Column], part: Column, copies: str, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail.

    Bit i of ``mask`` is filter i in the order of ``conditions``; the filter ``copies``
    comes last.  It removes a document whose text also stands under a smaller id in any
    part.  Its groups are never gathered: rows are added up by text, pattern and labels,
    and a text's smallest id tells how many of its rows stay.
    """
    text_of = F.coalesce(F.col(text), F.lit(""))
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())), F.lit(0))
    keyed = docs.select(F.col(doc_id).alias("id"), part.alias("part"), F.md5(text_of).alias("digest"), mask.alias("mask"))
    once = keyed.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    once = once.withColumn("deal", F.when(F.col("id").isNull(), F.pmod(F.hash("digest"), F.lit(_SPREAD))).otherwise(F.lit(0)))
    told = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    joined = once.join(told.withColumn("deal", F.lit(0)), ["id", "deal"], "left").fillna(0, ["good", "toxic"])
    by_text = joined.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))
    stays = F.col("no_id") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(F.lit(0))
    split = by_text.withColumn("stays", stays).select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask"), F.col("stays").alias("n")),
            F.struct((F.col("mask") + F.lit(1 << list(conditions).index(copies))).alias("mask"), (F.col("n") - F.col("stays")).alias("n")),
        )),
    )
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))


def coalitions(counted: DataFrame, n: int) -> DataFrame:
    """(part, n_docs, removed, good, toxic): what each of the 2^n coalitions removes, as
    arrays in the order of coalitions."""
    every = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("coalition"))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    sums = every.groupBy("part", "coalition").agg(F.sum("n").alias("n_docs"), *[F.sum(F.when(hit, F.col(c)).otherwise(F.lit(0))).alias(c) for c in ("n", "good", "toxic")])
    listed = F.sort_array(F.collect_list(F.struct("coalition", "n", "good", "toxic")))
    return sums.groupBy("part").agg(F.max("n_docs").alias("n_docs"), listed.alias("all")).select("part", "n_docs", F.col("all.n").alias("removed"), F.col("all.good").alias("good"), F.col("all.toxic").alias("toxic"))


def _orders(names: list[str]) -> Column:
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "own": names.index(order[k]), "before": sum(1 << names.index(x) for x in order[:k])}
        for order in permutations(names) for k in range(len(names))
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")


def audit(docs: DataFrame, conditions: Mapping[str, Column], part: Column, labels: DataFrame, copies: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per part, order of filters and step, with what the step's filter does.

    ``conditions`` maps one-letter names to what makes a document fail; the condition of
    ``copies`` is not read (see ``failures``).  ``labels`` has ``quality`` and ``toxic``
    by ``doc_id``; an id with several rows is good or toxic if any row says so.
    ``shapley`` is n! times the filter's Shapley value, which is what it removes in all
    orders together.  Nulls in ``text`` are empty; rows without id are never copies nor
    originals; rows that repeat id and text are no copies of each other; a part is a
    value of ``part``; no rows give no rows.  Further columns are not read.
    """
    names = list(conditions)
    n = len(names)
    if not 2 <= n <= MOST_FILTERS or any(len(x) != 1 for x in names):
        raise ValueError(f"2 to {MOST_FILTERS} filters with one-letter names")
    if copies in names[:-1]:
        raise ValueError("the filter of copies comes last")
    own = {k: F.lit(False) if k == copies else c for k, c in conditions.items()}
    table = coalitions(failures(docs, own, part, copies, labels, doc_id, text), n)
    solved = table.withColumn("values", F.array(*shapley_columns(F.col("removed"), n)))
    steps = solved.select("*", F.inline(_orders(names)))
    bit, full = F.call_function("shiftleft", F.lit(1), F.col("own")), F.lit((1 << n) - 1)
    after = F.col("before").bitwiseOR(bit)

    def gain(values: str, low: Column, high: Column) -> Column:
        return F.get(values, high) - F.get(values, low)

    removed = gain("removed", F.col("before"), after)
    return steps.select(
        "part", "filter_order", "step",
        (F.col("n_docs") - F.get("removed", after)).alias("kept"),
        removed.alias("removed"),
        (F.get("removed", bit) - removed).alias("redundant"),
        gain("removed", full - bit, full).alias("unique_fails"),
        gain("good", F.col("before"), after).alias("good_lost"),
        gain("toxic", F.col("before"), after).alias("toxic_lost"),
        F.get("values", F.col("own")).alias("shapley"),
    )


WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"


def text_filters(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with the counts that five usual filters need, and the filters: few words
    (A), repeated words (B), capitals (C), symbols (D) and copies (E)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = bind(docs.withColumn("_text", whole), _words=F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    counted = bind(
        counted,
        _n=F.size("_words").cast("long"),
        _distinct=F.size(F.array_distinct("_words")).cast("long"),
        _capitals=F.length(F.regexp_replace("_text", "[^A-Z]+", "")).cast("long"),
        _length=F.length("_text").cast("long"),
        _symbol=F.col("_text").rlike(SYMBOLS),
    )
    return counted, {
        "A": F.col("_n") < 100,
        "B": 100 * F.col("_distinct") < 80 * F.col("_n"),
        "C": 100 * F.col("_capitals") > 10 * F.col("_length"),
        "D": F.col("_symbol"),
        "E": F.lit(False),
    }

"""Mixing sources to target weights by hierarchical budgeting.

Sources are leaves of a tree of domain, language and source.  A token budget flows from
the root: each node's budget is shared among its children by weight, no child gets more
than its subtree can supply, and what one can't use goes to its siblings.  Only what all
children together can't use is missing at the parent, where it goes to the parent's
siblings.  A leaf's budget is a prefix of its documents in seeded epochs: whole passes,
then the first documents of one more pass.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtrail.llm.scratch import ROW, from_row, of_row, quoted, staged

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "language", "leaf_source")
KEY_BITS, STEP_BITS = 60, 12


class Mixture(NamedTuple):
    """``weights`` maps a node's path, such as ``("web", "en")``, to a positive whole
    number; other nodes weigh 1.  The budget is ``percent`` of the tokens there are; a
    document is used ``max_epochs`` times at most."""

    weights: dict[tuple[str, ...], int]
    percent: int = 60
    max_epochs: int = 4
    seed: int = 7


def tokens(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(mixture: Mixture, depth: int) -> Column:
    known = [(path, w) for path, w in mixture.weights.items() if len(path) == depth]
    path = F.concat_ws("\x1f", *LEVELS[:depth])
    if not known:
        return F.lit(1).cast("long")
    pairs = [x for p, w in known for x in (F.lit("\x1f".join(p)), F.lit(w).cast("long"))]
    return F.coalesce(F.create_map(*pairs)[path], F.lit(1).cast("long"))


def _fill(nodes: DataFrame, parent: tuple[str, ...]) -> DataFrame:
    """Share ``budget`` among the rows of a parent: those that their share would fill
    get their ``cap``, the rest divide what is left by ``weight``."""
    rank = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), *LEVELS[: len(parent) + 1])
    up_to, after = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(up_to), F.lit(0))
    full = nodes.withColumn("is_full", left * F.col("weight") >= F.col("cap") * F.sum("weight").over(after))
    used = F.sum(F.when(F.col("is_full"), F.col("cap")).otherwise(0)).over(all_rows)
    open_weight = F.sum(F.when(~F.col("is_full"), F.col("weight")).otherwise(0)).over(all_rows)
    full = full.withColumn("used", used).withColumn("open_weight", open_weight)
    target = F.when(F.col("is_full"), F.col("cap")).otherwise(F.expr("(budget - used) * weight div greatest(open_weight, 1)"))
    return full.withColumn("target", target).drop("is_full", "used", "open_weight", "budget", "weight")


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """The leaves (LEVELS, ``tokens``) with their ``target``."""
    capped = leaves.withColumn("cap", F.col("tokens") * mixture.max_epochs)
    total = F.expr(f"sum(tokens) * {mixture.percent} div 100")
    above = capped.groupBy().agg(total.alias("budget"))
    for depth in (1, 2, 3):
        keys = LEVELS[:depth]
        nodes = capped.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(mixture, depth))
        nodes = nodes.join(above, list(keys[:-1])) if depth > 1 else nodes.crossJoin(F.broadcast(above))  # one row
        filled = _fill(nodes, keys[:-1])
        above = filled.select(*keys, F.col("target").alias("budget"))
    return filled


def order_key(mixture: Mixture, epoch: Column, doc_id: Column, text: Column) -> Column:
    """Place of a document in an epoch of its leaf: 60 bits of a seeded digest."""
    name = F.concat_ws(":", F.lit(str(mixture.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long")


def _cuts(rows: DataFrame) -> DataFrame:
    """Per leaf the last key of the prefix that comes nearest to ``rest`` tokens.

    ``rows`` has LEVELS, key, tokens and rest.  Two rounds of 4096 buckets find the
    bucket that holds the end; only its rows are put in order.
    """
    found = rows.where("rest > 0").withColumn("low", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    for step in (1, 2):
        shift = KEY_BITS - STEP_BITS * step
        bucket = found.withColumn("bucket", F.shiftright("key", shift))
        sums = bucket.groupBy(*LEVELS, "bucket", "rest", "before").agg(F.sum("tokens").alias("n"))
        run = Window.partitionBy(*LEVELS).orderBy("bucket")
        sums = sums.withColumn("before", F.col("before") + F.sum("n").over(run) - F.col("n"))
        end = sums.where("before <= rest").withColumn("last", F.row_number().over(Window.partitionBy(*LEVELS).orderBy(F.desc("bucket")))).where("last = 1")
        end = end.select(*LEVELS, "bucket", "before", F.shiftleft("bucket", shift).alias("low"))
        found = bucket.drop("before", "low").join(end, [*LEVELS, "bucket"]).drop("bucket")
    by_key = found.groupBy(*LEVELS, "key", "rest", "low", "before").agg(F.sum("tokens").alias("n"))
    run = Window.partitionBy(*LEVELS).orderBy("key")
    by_key = by_key.withColumn("before", F.col("before") + F.sum("n").over(run) - F.col("n"))
    inside = F.max(F.when(F.expr("2 * before + n <= 2 * rest"), F.col("key")))
    return by_key.groupBy(*LEVELS).agg(F.coalesce(inside, F.min("low") - 1).alias("cut"))


def mix(docs: DataFrame, mixture: Mixture, domain: Column, lang: str = "lang", source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The chosen rows of ``docs`` with ``domain``, ``n_tokens`` and ``epoch``, a row
    for each epoch that uses them.

    The last epoch of a leaf ends where its tokens come nearest to the budget, so a leaf
    misses it by half a document at most.  A null domain, language or source is the node
    named by the empty text; rows without words count 0 tokens and follow their place in
    the order.  Rows that agree in id and text stand at one place, and are used or left
    together.  Columns of ``docs`` that are named like new ones are replaced; no rows
    give no rows.
    """
    names = (F.coalesce(domain, F.lit("")), F.coalesce(quoted(lang).cast("string"), F.lit("")), F.coalesce(quoted(source).cast("string"), F.lit("")))
    # The domain is worked out while columns still have their names.
    packed = F.struct(*[quoted(c) for c in docs.columns]).alias(ROW)
    plain = docs.select(packed, *[c.alias(n) for n, c in zip(LEVELS, names)]).withColumn("n_tokens", tokens(of_row(text)))
    counted = staged(plain.select(*LEVELS, F.col("n_tokens").alias("tokens"), of_row(doc_id).alias("id"), F.md5(F.coalesce(of_row(text), F.lit(""))).alias("digest")))
    plan = budgets(counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), mixture)
    plan = plan.selectExpr(*LEVELS, "cap >= 0 as known", "target div greatest(tokens, 1) as full", "target % greatest(tokens, 1) as rest")
    plan = staged(plan)
    rows = counted.join(plan.where("rest > 0"), list(LEVELS))
    key = F.concat_ws(":", F.lit(str(mixture.seed)), F.col("full").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), "digest")
    rows = rows.select(*LEVELS, "tokens", "rest", F.conv(F.substring(F.md5(key), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"))
    plan = plan.drop("known", "rest").join(_cuts(rows), list(LEVELS), "left").withColumn("cut", F.coalesce("cut", F.lit(-1)))
    used = plain.join(staged(plan), list(LEVELS))
    last = F.col("cut") >= order_key(mixture, F.col("full"), of_row(doc_id), of_row(text))
    passes = F.col("full") + F.when(last, 1).otherwise(0)
    used = used.withColumn("epochs", passes).where("epochs > 0")
    epoch = F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch")
    return used.select(*from_row(docs, LEVELS[0], "n_tokens", "epoch"), LEVELS[0], "n_tokens", epoch)

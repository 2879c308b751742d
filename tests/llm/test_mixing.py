"""The mixture against a plain water filling and a plain reading of the epochs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigtrail.llm.mixing import Mixture, mix
from tests.llm.test_words import WORD


def share(budget, caps, weights):
    """Budget per child: full ones get their cap, the rest divide what is left."""
    order = sorted(caps, key=lambda c: (caps[c] / weights[c], c))
    out, left, weight = {}, budget, sum(weights.values())
    for at, c in enumerate(order):
        if left * weights[c] >= caps[c] * weight:
            out[c] = caps[c]
            left, weight = left - caps[c], weight - weights[c]
        else:
            return out | {x: left * weights[x] // weight for x in order[at:]}
    return out


def expected(rows, mixture, domain):
    docs = [(domain(s or ""), l or "", s or "", i, t, len(WORD.findall(t or ""))) for i, t, l, s in rows]
    tokens = Counter()
    for d, l, s, _, _, n in docs:
        tokens[d, l, s] += n
    budgets = {(): sum(tokens.values()) * mixture.percent // 100}
    for depth in (1, 2, 3):
        caps = defaultdict(Counter)
        for path, n in tokens.items():
            caps[path[: depth - 1]][path[:depth]] += n * mixture.max_epochs
        for parent, own in caps.items():
            budgets |= share(budgets[parent], own, {c: mixture.weights.get(c, 1) for c in own})
    out = Counter()
    for leaf, n in tokens.items():
        own = [x for x in docs if x[:3] == leaf]
        whole, rest = divmod(budgets[leaf], max(n, 1))
        for e in range(whole):
            out.update((x[3], x[4], e) for x in own)
        key = lambda x: hashlib.md5(f"{mixture.seed}:{whole}:{'' if x[3] is None else x[3]}:{hashlib.md5((x[4] or '').encode()).hexdigest()}".encode()).hexdigest()[:15]
        groups = defaultdict(list)
        for x in own:
            groups[key(x)].append(x)
        before = 0
        for k in sorted(groups):
            here = sum(x[5] for x in groups[k])
            if rest and 2 * before + here <= 2 * rest:
                out.update((x[3], x[4], whole) for x in groups[k])
            before += here
    return out


@pytest.mark.parametrize("percent,epochs", [(60, 4), (90, 1)])
def test_mixture_equals_plain_reading(spark, documents, percent, epochs):
    rng = random.Random(percent)
    rows = [(i, " ".join("w" * rng.randint(1, 40)), rng.choice(["en", "en", "de", None]), rng.choice(["src1", "src1", "src1", "src2", "src12", "src17", None])) for i in range(300)]
    rows += [(300, None, "en", "src1"), (301, "", "en", "src1"), (5, "a b c", "en", "src1"), (5, "a b c", "en", "src1"), (None, "a b", "en", "src1"), (302, "word " * 3000, "de", "src2")]
    mixture = Mixture({("web",): 3, ("web", "en"): 5, ("web", "en", "src2"): 7}, percent=percent, max_epochs=epochs)
    domain = F.when(F.col("source").isin("src1", "src2"), "web").when(F.col("source").isNotNull(), "books")
    docs = documents(rows).withColumn("epoch", F.lit("mine"))
    got = Counter((r.doc_id, r.text, r.epoch) for r in mix(docs, mixture, domain).collect())
    assert got == expected(rows, mixture, lambda s: "web" if s in ("src1", "src2") else "books" if s else "")
    assert got


def test_no_rows_and_no_words(spark, documents):
    mixture = Mixture({})
    assert mix(documents([]), mixture, F.lit("d")).count() == 0
    assert mix(documents([(1, ""), (2, None)]), mixture, F.lit("d")).count() == 0

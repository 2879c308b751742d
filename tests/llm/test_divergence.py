from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from sigtrail.llm import divergence as module
from sigtrail.llm.divergence import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top):
    docs = [(x[2] or "", x[3] or "", [t.translate(LOWER) for t in TERM.findall(x[1] or "")]) for x in rows]
    df = Counter((lang, t) for lang, _, ts in docs for t in set(ts))
    kept = {k for k, n in df.items() if n >= min_docs}
    sources, counts = defaultdict(set), Counter()
    for lang, source, ts in docs:
        sources[lang].add(source)
        counts.update((lang, source, t) for t in ts if (lang, t) in kept)
    out = set()
    for lang, mine in sources.items():
        vocabulary = [t for k, t in kept if k == lang]

        def share(of):
            n = {t: sum(counts[lang, s, t] for s in of) for t in vocabulary}
            total = sum(n.values())
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(vocabulary)) for t in vocabulary}

        p, q = {s: share([s]) for s in mine}, share(mine)
        for s in mine:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in vocabulary), o.encode()) for o in mine if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in vocabulary if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(items)[:most])}
    return out


def made(seed, docs, sources):
    rng = random.Random(seed)
    pool = ["Alpha", "beta", "GAMMA", "é", "Été", "日本", "x", "İ", "ẞ", "𝒳y"] + [f"rare{chr(97 + i)}" for i in range(20)]
    join = [" ", "-", "1", "\n", "[", "~", "\0"]
    rows = []
    for i in range(docs):
        words = [rng.choice(pool[: rng.choice([4, 10, 30])]) + rng.choice(join) for _ in range(rng.randrange(12))]
        rows.append((i, "".join(words), rng.choice(["en", "de", None]), rng.choice(sources)))
    return rows + [(None, None, "en", "empty"), (None, "beta", "fr", None), (1, "", "", "")]


@pytest.mark.parametrize("slice_terms", [1 << 22, 10])
def test_against_plain_counts(spark, documents, slice_terms):
    rows = made(1, 150, ["a", "b", "c", None, "Z"])
    got = divergence(documents(rows).selectExpr("*", "'mine' AS term", "1 AS n", "2 AS rank", "3 AS terms"), min_docs=6, top=4, slice_terms=slice_terms).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain(rows, 6, 4)


def test_more_sources_than_a_block(spark, documents):
    rows = made(2, 120, [f"s{i}" for i in range(11)])
    assert {tuple(r) for r in divergence(documents(rows), min_docs=5, top=50, block=3).collect()} == plain(rows, 5, 50)


def test_no_kept_terms_and_no_rows(spark, documents):
    rows = [(1, "one two", "en", "a"), (2, "", "en", "b"), (3, None, None, None)]
    assert {tuple(r) for r in divergence(documents(rows)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence(documents([])).collect() == []


def test_counts_beyond_long_products(spark):
    from pyspark.sql import functions as F

    n = 10**13
    got = spark.range(1).select(module._share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (3 * n + 35)


def test_more_languages_than_marks(spark, documents):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(6)), f"l{i % 70}", f"s{i % 3}") for i in range(420)]
    assert {tuple(r) for r in divergence(documents(rows), min_docs=3, top=2).collect()} == plain(rows, 3, 2)

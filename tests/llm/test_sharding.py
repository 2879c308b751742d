from __future__ import annotations

import random
from collections import Counter, defaultdict

from sigtrail.llm.sharding import shard


def check(rows, shards, tolerance):
    total = sum(r["size"] for r in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert all(0 <= s < shards for s in sizes)
    assert all(abs(sizes[i] - total / shards) <= tolerance * total / shards + largest + 1 for i in range(shards))


def test_bytes_are_nearly_equal_and_slots_gapless(spark, documents):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(600)] + [(i, "copy of a text") for i in range(600, 900)]
    rows += [(None, None), (None, None), (7, ""), (7, ""), (901, "é" * 50)]
    docs = documents(rows).selectExpr("*", "'mine' AS size", "'mine' AS slot")
    got = [r.asDict() for r in shard(docs, shards=6, rows_per_run=40).collect()]
    assert len(got) == len(rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in got)
    check(got, 6, 0.002)
    again = [r.asDict() for r in shard(docs.repartition(5), shards=6, rows_per_run=40).collect()]
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_copies_are_neighbours(spark, documents):
    got = shard(documents([(i, f"text {i % 10}") for i in range(200)]), shards=4).collect()
    spans = defaultdict(set)
    for r in got:
        spans[r.text].add(r.shard)
    assert sum(len(s) > 1 for s in spans.values()) <= 3


def test_few_or_no_rows(spark, documents):
    assert shard(documents([]), shards=3).count() == 0
    assert [(r.shard, r.slot) for r in shard(documents([(1, "a")]), shards=1).collect()] == [(0, 0)]
    assert sorted(r.doc_id for r in shard(documents([(1, "a"), (2, "b")]), shards=24).collect()) == [1, 2]


def test_copies_of_a_text_are_many_runs(spark, documents):
    from sigtrail.llm import sharding

    rows = [(i, "") for i in range(500)] + [(1000 + i, "b" * (i % 40)) for i in range(300)] + [(2000 + i, "copy") for i in range(400)]
    frame = shard(documents(rows), shards=3, rows_per_run=50)
    got = [r.asDict() for r in frame.collect()]
    check(got, 3, 0.002)
    groups = Counter()
    for r in got:
        groups[r["text"]] += 1
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "piece" in plan and groups[""] == 508 and sharding.MOST_LARGE >= 2

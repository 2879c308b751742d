from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from sigtrail.llm.coalitions import audit, inverse, normal_equations, text_filters

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """All orders applied one after the other, as the audit is meant to read."""
    good, toxic = Counter(), Counter()
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        docs.append((lang or "", fails, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                lost = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                fail = [d for d in mine if d[1][f]]
                only = [d for d in fail if sum(d[1].values()) == 1]
                out[part, "".join(order), k + 1] = [len(left), len(lost), len(fail) - len(lost), len(only), sum(d[2] for d in lost), sum(d[3] for d in lost)]
        for f in "ABCDE":
            shapley = sum(v[1] for (p, o, k), v in out.items() if p == part and o[k - 1] == f)
            for (p, o, k), v in out.items():
                if p == part and o[k - 1] == f:
                    v.append(shapley)
    return out


def texts(rng, n):
    pool = [f"w{i}" for i in range(300)]
    made = []
    for i in range(n):
        words = [rng.choice(pool[: rng.choice([40, 300])]) for _ in range(rng.choice([3, 99, 100, 130]))]
        text = " ".join(words) + rng.choice(["", " #", " AAAA", "\t|"]) + rng.choice(["", " " + "CAPS " * 20])
        made.append(rng.choice([text, text, rng.choice(made) if made else text]))
    return made


@pytest.fixture
def run(spark):
    def go(rows, labels, schema="doc_id long, text string, lang string"):
        docs, conditions = text_filters(spark.createDataFrame(rows, schema).withColumn("mask", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("id", F.lit("x")))
        got = audit(docs, conditions, F.coalesce("lang", F.lit("")), spark.createDataFrame(labels, LABELS).withColumn("good", F.lit(0)), copies="E")
        return {(r[0], r[1], r[2]): list(r[3:]) for r in got.collect()}

    return go


def test_against_all_orders(run):
    rng = random.Random(3)
    made = texts(rng, 60)
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(made)]
    rows += [(None, made[0], "en"), (None, made[0], "en"), (None, None, None), (70, None, "de"), (71, "", "de"), (3, made[3], "en"), (3, made[3], "en"), (5, made[9], "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert run(rows, labels) == plain(rows, labels)


def test_copies_in_other_parts_and_large_groups(run):
    rows = [(i, "a text that many documents share", ["en", "de", "fr"][i % 3]) for i in range(90)]
    assert run(rows, []) == plain(rows, [])


def test_no_rows(run):
    assert run([], [(1, 1, 1)]) == {}


def test_normal_equations_are_solved_exactly():
    for n in range(2, 7):
        rows = normal_equations(n)
        got = inverse(rows)
        for i in range(n + 1):
            for j in range(n + 1):
                assert sum((rows[i][k] * got[k][j] for k in range(n + 1)), Fraction(0)) == (i == j)


@pytest.mark.parametrize("n", [2, 6])
def test_other_numbers_of_filters(spark, n):
    rng = random.Random(n)
    rows = [(i, "".join(rng.choice("01") for _ in range(n)), "x") for i in range(40)]
    names = "ABCDEF"[:n]
    conditions = {name: F.substring("text", i + 1, 1) == "1" for i, name in enumerate(names[:-1])} | {names[-1]: F.lit(False)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = audit(docs, conditions, F.col("lang"), spark.createDataFrame([], LABELS), copies=names[-1]).collect()
    assert len(got) == factorial(n) * n
    for name in names:
        mine = [r for r in got if r.filter_order[r.step - 1] == name]
        assert {r.shapley for r in mine} == {sum(r.removed for r in mine)}


def test_arguments_are_checked(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    with pytest.raises(ValueError):
        audit(docs, {"E": F.lit(False)}, F.col("lang"), labels, copies="E")
    with pytest.raises(ValueError):
        audit(docs, {"E": F.lit(False), "A": F.lit(True)}, F.col("lang"), labels, copies="E")

"""Line deduplication against a plain comparison of all lines."""

from __future__ import annotations

import random

from sigtrail.llm.lines import dedup_lines


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, least):
    """Texts of distinct ids, in the order of the ids."""
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            if not line.strip(" "):
                kept.append(line)
                continue
            if not any(line == e or (min(len(line), len(e)) >= least and distance_one(line, e)) for e in seen):
                kept.append(line)
            seen.append(line)
        out[doc_id] = "\n".join(kept)
    return out


def test_lines_equal_plain_comparison(spark, documents):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(3, 30))).strip() or "x" for _ in range(40)]

    def edited(line):
        at = rng.randrange(len(line) + 1)
        return rng.choice([line, line[:at] + "z" + line[at:], line[:at] + line[at + 1 :], line[:at] + "q" + line[at + 1 :]])

    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(0, 8))) + rng.choice(["", "\n", "\n\n "])) for i in range(60)]
    long = "".join(rng.choice("abc") for _ in range(3000))
    rows += [(100, long), (101, long[:1500] + long[1501:]), (102, long[:-1] + "z"), (103, long[5:])]
    got = {r.doc_id: r for r in dedup_lines(documents(rows), least_chars=10).collect()}
    want = expected(rows, 10)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_lines == len(text.split("\n")) for i, text in rows for r in [got[i]])


def test_nulls_ties_and_repeated_rows(spark, documents):
    line = "a line that is long enough"
    rows = [(1, None), (2, ""), (3, line), (3, line), (None, line + "\nonly here, without an id"), (None, None), (4, line + "!\n\nnew")]
    docs = documents(rows).selectExpr("*", "'mine' AS n_kept", "'x' AS doc", "1 AS version")
    got = sorted(((r.doc_id is None, r.doc_id), r.text, r.n_lines, r.n_kept) for r in dedup_lines(docs).collect() if r.doc_id is not None)
    assert got == [((False, 1), None, 0, 0), ((False, 2), "", 1, 1), ((False, 3), line, 1, 1), ((False, 3), line, 1, 1), ((False, 4), "\nnew", 3, 2)]
    none = {(r.text, r.n_kept) for r in dedup_lines(docs).collect() if r.doc_id is None}
    assert none == {("only here, without an id", 1), (None, 0)}


def test_no_rows(spark, documents):
    assert dedup_lines(documents([])).count() == 0

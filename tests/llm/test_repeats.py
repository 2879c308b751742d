from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from sigtrail.llm.repeats import subtree_repeats, without_repeats

BLANKS = " \t\n\v\f\r"


def split(text):
    for c in BLANKS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(rows, window):
    """Rows in order of id; those without id last."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = split(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    passages = [[f"p{k}w{rng.randrange(40)}" for _ in range(rng.randrange(5, 40))] for k in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice([rng.choice(passages), [f"w{rng.randrange(400)}" for _ in range(rng.randrange(15))], ["la"] * rng.randrange(30), ["a", "b"] * rng.randrange(14), ["Case", "case"]])
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t\r "]) for w in words)))
    return rows + [(n + j, rows[j][1]) for j in range(0, n, 7)]


@pytest.mark.parametrize("window,prefix,group", [(20, 8, 4096), (7, 3, 4096), (7, 3, 3)])
def test_against_plain_windows(spark, documents, window, prefix, group):
    rows = corpus(window + group, 60)
    docs = documents(rows).selectExpr("*", "1 AS h", "'mine' AS marks", "2 AS ord", "3 AS copy").repartition(5)
    assert found(without_repeats(docs, window=window, prefix=prefix, group=group)) == plain(rows, window)


def test_many_tasks_and_one_slice_agree(spark, documents):
    rows = corpus(8, 80)
    want = plain(rows, 6)
    assert found(without_repeats(documents(rows).repartition(16), window=6, prefix=2, group=5, at_once=1)) == want
    assert found(without_repeats(documents(rows).coalesce(1), window=6, prefix=2)) == want


def test_nulls_empty_repeated_rows_and_ids(spark, documents):
    long = " ".join(f"x{i}" for i in range(25))
    rows = [(None, None), (1, ""), (2, "  \n"), (3, long), (3, long), (3, long), (None, long), (None, long), (9, "short text"), (9, "short text"), (9, long + " y")]
    got = found(without_repeats(documents(rows)))
    want = Counter({(None, 0, 0, ""): 1, (1, 0, 0, ""): 1, (2, 0, 0, ""): 1, (3, 25, 0, long): 1, (3, 25, 25, ""): 2, (None, 25, 25, ""): 2, (9, 2, 0, "short text"): 2, (9, 26, 25, "y"): 1})
    assert got == want


def test_no_rows(spark, documents):
    assert without_repeats(documents([])).collect() == []


def test_a_long_text_of_one_word_and_spans(spark, documents):
    rows = [(1, "la " * 50_000), (2, "start " + "la " * 30 + "end")]
    got = {r.doc_id: r for r in without_repeats(documents(rows)).collect()}
    assert (got[1].n_words, got[1].n_removed, [tuple(s) for s in got[1].spans]) == (50_000, 49_999, [(1, 50_000)])
    assert got[2].text == "start end" and [tuple(s) for s in got[2].spans] == [(1, 31)]


def test_text_is_kept_byte_for_byte(spark, documents):
    text = "Ünïcode 日本  𝒳\x00y z   end"
    assert without_repeats(documents([(1, text)])).first().text == " ".join(split(text))


def test_nodes_of_a_subtree():
    rng = np.random.default_rng(1)
    around = rng.integers(1, 3, size=(300, 9)).astype(np.uint32)  # 3 words before, 6 after
    key = np.repeat([7, 9, 11], 100)
    low, high = rng.integers(0, 3, 300), np.full(300, 3)
    place = [rng.integers(0, 50, 300), np.zeros(300, np.int64), np.arange(300)]
    bits = subtree_repeats(key, around, low, high, place, window=6, prefix=3)
    for i in range(300):
        for d in range(4):
            mine = (key[i], *around[i, 3 - d : 9 - d])
            earlier = any((key[j], *around[j, 3 - d : 9 - d]) == mine and low[j] <= d and (place[0][j], j) < (place[0][i], i) for j in range(300))
            assert bool(bits[i] >> d & 1) == (earlier and low[i] <= d)

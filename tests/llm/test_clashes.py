"""Extra columns named like anything that the operators name internally."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigtrail import llm
from sigtrail.llm import coalitions, decontaminate, divergence, extraction, jaccard, lines, mixing, quality, repeats, secrets, sharding, urls, vectors
from sigtrail.llm.queries import MIXTURE, URL_RULES, domain

FOLDER = Path(llm.__file__).parent
RETURNING = ("scratch", "mixing", "lines", "jaccard", "decontaminate", "quality", "sharding", "urls")
NAMES = sorted({n for f in RETURNING for n in re.findall(r"""(?:alias|withColumn)\(["'](\w+)["']""", (FOLDER / f"{f}.py").read_text())} | {"full", "cut", "offset", "doc", "version", "quality", "id", "key", "run", "zone", "place"})
TEXTS = ["Buy now!!! $$$ | CLICK\n", "A quiet line of text about the river and its banks.\nAnother line of it, a little longer than that.\n" * 3]


def with_extras(df, *own):
    extra = [n for n in NAMES if n.lower() not in {c.lower() for c in (*df.columns, *own)}]
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in extra]), extra


@pytest.fixture
def docs(documents):
    rows = [(i, TEXTS[i % 2] + f"number {i // 4} of the few", "en" if i % 3 else "de", f"src{i % 3}") for i in range(24)]
    return with_extras(documents(rows + [(None, None, None, None)]))


@pytest.fixture
def tables(spark, docs):
    rows = [(i, i % 2, 0) for i in range(24)]
    items = [(1, TEXTS[1])]
    return {
        "labels": with_extras(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))[0],
        "benchmark": with_extras(spark.createDataFrame(items, "item_id long, text string"))[0],
    }


def kept(df, extra, *new):
    """The operator's rows, with all extra columns that it doesn't itself name."""
    stays = [n for n in extra if n not in new]
    assert set(stays) <= set(df.columns) and len(set(df.columns)) == len(df.columns)
    rows = df.select(*stays).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple(f"mine {n}" for n in stays)]


def test_names_were_found():
    assert len(NAMES) > 40 and {"offset", "full", "cut", "doc", "version", "quality", "id", "key", "run"} <= set(NAMES)


def test_operators_that_return_the_documents(docs, tables):
    df, extra = docs
    kept(mixing.mix(df, MIXTURE, domain()), extra, "domain", "n_tokens", "epoch")
    kept(lines.dedup_lines(df), extra, "n_lines", "n_kept")
    kept(jaccard.keep_first(df, jaccard.Similarity(k=5, numerator=80)), extra)
    kept(decontaminate.clean(df, tables["benchmark"]), extra)
    kept(quality.score(df, quality.fit(df, tables["labels"])), extra, "score")
    kept(sharding.shard(df, shards=3), extra, "size", "shard", "slot")


def test_operators_with_columns_of_their_own(spark, docs, tables):
    df, extra = docs
    plain = df.drop(*extra)
    same = lambda f: sorted(map(str, f(df).collect())) == sorted(map(str, f(plain).collect()))
    assert same(lambda d: decontaminate.contained(d, tables["benchmark"]))
    assert same(lambda d: jaccard.near_classes(d, jaccard.Similarity(k=3, numerator=90)))
    assert same(secrets.find_secrets)
    assert same(divergence.divergence)
    assert same(repeats.without_repeats)

    def audited(d):
        counted, conditions = coalitions.text_filters(d)
        return coalitions.audit(counted, conditions, F.coalesce("lang", F.lit("")), tables["labels"], copies="E")

    assert same(audited)


def test_pages_and_vectors(spark):
    pages, extra = with_extras(spark.createDataFrame([(1, "http://a.org/x", "<article><p>Some text</p></article>"), (2, None, None)], "page_id long, url string, html string"))
    kept(urls.judge(pages, URL_RULES), extra, "host", "path", "rule", "trust", "distrust", "verdict")
    assert extraction.extract(pages).count() == 2
    rows, _ = with_extras(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1)], "vec_id long, embedding array<float>, label int"))
    assert {r.component_id for r in vectors.near_vectors(rows).collect()} == {1}


def test_pipeline(spark, documents, tables, tmp_path):
    rows = [(i, " ".join(f"word{i}of{k}" for k in range(30)) + ".", "en", f"src{i % 3}") for i in range(40)]
    df, extra = with_extras(documents(rows))
    good = with_extras(spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int"))[0]
    for name, table in (tables | {"documents": df, "labels": good}).items():
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    # The mixture names three columns itself, and so replaces those.
    kept(corpus_pipeline.run(spark, str(tmp_path)), extra, "size", "shard", "slot", "domain", "n_tokens", "epoch")

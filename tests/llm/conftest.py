from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) or (doc_id, text, lang, source) as a table of documents."""

    def build(rows, schema=DOCS):
        full = [(r[0], r[1], *(r[2:] or ("en", "src1")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return build

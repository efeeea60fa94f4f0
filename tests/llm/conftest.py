import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts; ids count from 0 unless given as (id, text)."""

    def build(texts, lang="en"):
        rows = []
        for i, text in enumerate(texts):
            at, value = text if isinstance(text, tuple) else (i, text)
            rows.append((at, value, lang, "s", None if value is None else len(value)))
        return spark.createDataFrame(rows, DOCS)

    return build

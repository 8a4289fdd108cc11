import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text[, lang[, source]]) rows, with columns whose names clash with outputs."""

    def make(rows, clash=True):
        full = []
        for r in rows:
            r = (*r, *[None] * (4 - len(r)))
            full.append((*r, None if r[1] is None else len(r[1])))
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in ("score", "kept", "component", "fp", "size", "shard", "copies", "pii", "salt_", "id", "bucket", "n_tokens"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def by_id():
    return lambda df, key="doc_id": {r[key]: r for r in df.collect()}

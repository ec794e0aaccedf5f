from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, extra=False):
        """doc_id from 0; with extra, columns whose names operators use inside."""
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            for c in ("label", "row", "node", "score", "found", "base", "doc", "x", "n", "key"):
                df = df.selectExpr("*", f"'{c}' AS {c}")
        return df

    return make

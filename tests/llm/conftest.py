import os
import sys

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table (with extra columns whose names clash with the
    operators' own) from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2:], len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "1 AS size", "'x' AS key", "2.5 AS score", "'t' AS token", "0 AS n", "'b' AS bucket",
                             "array(1) AS ids", "'r' AS m", "7 AS tid")
    return make


@pytest.fixture(scope="session")
def long_text():
    """A very long text: 200,000 words, no two 5-word windows alike."""
    return " ".join(f"w{i % 977}x{i // 977}" for i in range(200_000))

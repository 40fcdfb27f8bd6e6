import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, None), (2, ""), (3, "one"), (4, "a  b\n\n c   d <|endoftext|> é"), (5, "Same text here now and then again"),
    (6, "Same text here now and then again"), (7, "word " * 9000), (8, "x" * 150_000), (9, "\x00\x7f | ### ß Σ İ"), (10, " \n\t "),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], SCHEMA)
        return df.selectExpr("*", "1L as start", "'x' as labels", "0 as score", "text as spans", "doc_id as rank", "'k' as task") if clash else df

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)

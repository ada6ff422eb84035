import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, empty and long texts, repeated rows, ties, and columns named as internal ones."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, "en", None),
            (3, "", None, ""), (None, "no id but words", "en", "a"), (None, None, None, None), (4, long, "en", "b"),
            (5, "One TWO three four five six", "en", "b"), (6, " \t\n ", "en", "c"), (7, "x", "en", "a"), (8, "é" * 5000, "fr", "b"),
            (9, "mail a.b@c.org, +1 (234) 555-1234, 4111 1111 1111 1111", "en", "c"), (7, "y other text", "en", "a")]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, "k", 2.0, 3, "p") for i, t, lang, s in rows],
                                 DOCS + ", size int, key string, score double, id int, stretch string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

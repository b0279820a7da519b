import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers_llm import DOCS, words  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, wordless and long texts, ties, repeated rows, clashing columns."""
    long_text = words(30_000, 9)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \t\n ", "en", "s", 4),
        (4, "one two", None, None, 7),
        (4, "one two", None, None, 7),
        (5, "ONE two", "en", "s", 7),
        (None, "one two", "en", None, None),
        (None, None, None, None, None),
        (6, words(60), "en", "s", 1),
        (6, words(60, 1), "en", "s", 1),
        (7, words(60) + " tail", "en", "s", 1),
        (8, long_text, "en", "s", 1),
        (9, "123 !! %% 45", "de", "s", 1),
        (10, "naïve ünder \U0001f600  spaced  out \x1f x", "de", "s", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("node", "label", "key", "row", "words", "n", "size", "part", "shard", "cell", "h1", "item_id", "own", "rank", "_text", "text_hash", "html", "nth"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

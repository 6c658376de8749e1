import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_words import words  # noqa: E402

#: Rows every operator must take: nulls, empty and long texts, ties, repeats and a clashing column.
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.StringType()), T.StructField("score", T.StringType()), T.StructField("key", T.StringType()),
])


@pytest.fixture(scope="session")
def odd_rows():
    base, other = words(1, 120), words(2, 90)
    changed = base.split(" ")
    changed[60] = "different"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, " ".join(changed), "b"), (4, None, None), (5, "", "b"), (6, " \t\n", "b"), (7, "one", "a"),
        (8, "Ünï cödé 語 ÅÄÖ " + other, "c"), (9, other, "a"), (9, other, "a"), (None, words(3, 40), "a"), (None, base[:300], None),
        (10, "x" * 5000, "a"), (11, words(4, 6000), "a"), (12, "ab " * 700, "b"), (13, "A b C d", "b"), (14, "a B c D", "b"),
    ]
    return [(i, t, s, 5, "old", "old", "k") for i, t, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

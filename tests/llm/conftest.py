from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.llm.samples import SCHEMA, make


@pytest.fixture(scope="session")
def rows():
    return make()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nobody(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null keys, a repeated row and columns whose names clash with those of the operators."""
    rows = [(None, "null key " * 20, None, None, None), (7, None, "en", "a", 0), (7, None, "en", "a", 0),
            (8, "twice the same row", "en", "a", 18), (8, "twice the same row", "en", "a", 18)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("words", "block", "size", "hash", "print", "a", "b", "n_words", "kept", "word", "line", "row", "score"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame

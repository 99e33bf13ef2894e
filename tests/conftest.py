from __future__ import annotations

import pytest

from lucidex.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column expression over one row of literals."""
    from pyspark.sql import functions as F

    def run(build, *values):
        row = spark.range(1).select(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(values)])
        return row.select(build(*[F.col(f"v{i}") for i in range(len(values))]).alias("out")).first()["out"]

    return run


@pytest.fixture(scope="session")
def many(spark):
    """Evaluate a column expression over a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(build, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r["out"] for r in rows.select("i", build(F.col("t")).alias("out")).orderBy("i").collect()]

    return run

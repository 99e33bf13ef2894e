"""Every row of the tables reaches the inputs of the registered queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lucidex.plans.inputs import Inputs

KEY = ["site_id", "content_id"]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_every_document_and_page_is_read(spark, folder):
    inputs = Inputs(spark, folder)
    documents, pages = (spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("documents", "pages"))
    assert inputs.content.count() == inputs.content.select(*KEY).distinct().count() == documents + pages
    assert inputs.descriptions.select(*KEY).distinct().count() == inputs.descriptions.count() == documents
    assert inputs.store.select(*KEY).distinct().count() == inputs.store.count() == documents
    assert inputs.bodies.count() == documents
    texts = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("text").alias("markdown")).distinct()
    kept = inputs.store.select("markdown").distinct()
    blanked = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id % 9 = 0").select(F.col("text").alias("markdown")).distinct()
    assert texts.subtract(kept).subtract(blanked).count() == 0


def test_every_event_reaches_the_feed(spark):
    folder = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{folder}/events.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    known = events.join(documents.select(F.col("doc_id").alias("user_id")), "user_id", "left_semi")
    feed = Inputs(spark, folder).sample("changes")
    assert feed.select("event_id").distinct().count() == known.count()

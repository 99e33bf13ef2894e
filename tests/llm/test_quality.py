from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidex.llm import quality
from tests.llm.samples import words

SF = "/root/testdata/sf0.1"


def test_gradients():
    rng = np.random.default_rng(1)
    passages = np.array([1, 3, 2])
    features, labels = rng.normal(size=(6, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    model = quality.fit(features, passages, labels, epochs=1)

    def loss():
        p = model.forward(features, passages)["score"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for name, found in model.gradients(features, passages, labels).items():
        at = tuple(rng.integers(0, n) for n in found.shape)
        kept = model.weights[name][at]
        model.weights[name][at] = kept + 1e-5
        up = loss()
        model.weights[name][at] = kept - 1e-5
        down = loss()
        model.weights[name][at] = kept
        assert found[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_passages_of_whole_texts(rows, monkeypatch):
    texts = [r[1] or "" for r in rows]
    features, passages = quality.encode_passages(texts)
    assert passages.tolist() == [max(1, -(-len(words(t)) // quality.PASSAGE_WORDS)) for t in texts]
    monkeypatch.setattr(quality, "SLICE_WORDS", 100)
    again, _ = quality.encode_passages(texts)
    assert np.allclose(features, again)
    one = np.concatenate([quality.encode_passages([t])[0] for t in texts])
    assert np.allclose(features, one)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    told = found.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).collect()
    right = {r["quality"]: r["right"] for r in told}
    assert right[1] > 0.97 and right[0] > 0.8, right


def test_odd_tables(spark, nobody, odd, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(nobody, none).count() == 0
    assert {r["score"] for r in quality.classify(odd, none).collect()} == {0.5}
    labels = spark.createDataFrame([(None, 1, 0), (3, None, 0), (9, 1, 0), (9, 0, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)

from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from tokenizers import Tokenizer

from lucidex.llm import blocks, bpe


def by_hand(texts):
    model = Tokenizer.from_file(bpe.default_tokenizer())
    out = []
    for t in texts:
        ids = model.encode(t or "", add_special_tokens=False).ids
        back = model.decode(ids, skip_special_tokens=False)
        out.append((ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def test_against_the_library(docs, rows):
    got = {r["doc_id"]: (r["ids"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(docs, with_ids=True).collect()}
    assert got == dict(zip([r[0] for r in rows], by_hand([r[1] for r in rows])))


def test_small_blocks_and_slices(docs, rows, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(bpe, "SLICE_WORDS", 50)
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode(docs).collect()}
    assert got == {r[0]: w[1] for r, w in zip(rows, by_hand([r[1] for r in rows]))}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=40, max_size=40))
def test_any_text(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["decoded_sha256"] for r in bpe.encode(frame).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


def test_decode(spark):
    texts = ["plain words", "é 东 🙂", "<|endoftext|>"]
    ids = [x[0] for x in by_hand(texts)]
    frame = spark.createDataFrame(list(enumerate(ids)), "k int, ids array<int>")
    got = {r["k"]: bytes(r["decoded"]).decode() for r in bpe.decode(frame, ["k"], bpe.default_tokenizer()).collect()}
    assert got == dict(enumerate(texts))


def test_odd_tables(nobody, odd):
    assert bpe.encode(nobody).count() == 0
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in bpe.encode(odd).collect())
    assert [g[0] for g in got] == [-1, 7, 7, 8, 8] and got[1][1] == 0 and got[3] == got[4]

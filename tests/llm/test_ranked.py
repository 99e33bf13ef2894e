"""Ranked search against plain scoring of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lucidex.llm import ranked
from tests.llm.samples import SCHEMA

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """All documents scored for each item: {item_id: [(doc_id, score), ...]}."""
    parsed = [(doc_id, terms(text)) for doc_id, text in docs]
    n = sum(1 for _, t in parsed if t)
    total = sum(len(t) for _, t in parsed)
    df = Counter(t for _, own in parsed for t in set(own))
    out = {}
    for item_id, text in items:
        scores = []
        for doc_id, own in parsed:
            if own:
                tf, m = Counter(own), 25 + (75 * len(own) * n) // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
                            for t in terms(text) if tf[t])
                scores.append((doc_id, score))
        best = sorted((s for s in scores if s[1] > 0), key=lambda s: (-s[1], s[0] is None, s[0]))[:k]
        if best:
            out[item_id] = best
    return out


def found(frame):
    rows = sorted(frame.collect(), key=lambda r: (r["item_id"], r["rank"]))
    out = {}
    for r in rows:
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


ITEMS = [(1, "One two THREE"), (2, "the the of"), (3, ""), (4, None), (5, "!!! --"), (6, "nosuchword"), (7, "changed line here é 东 🙂"),
         (8, "a b c d"), (9, "x" * 3000), (10, "spam one")]


@pytest.mark.parametrize("posting_limit, block_chars", [(None, None), (40, None), (200, 500)])
def test_against_brute_force(spark, docs, rows, monkeypatch, posting_limit, block_chars):
    items = ITEMS + [(100 + i, rows[i][1][:400]) for i in range(20, 40)]
    queries = spark.createDataFrame(items, "item_id long, text string")
    if posting_limit:
        monkeypatch.setattr(ranked, "SEGMENT_POSTINGS", posting_limit)
    assert found(ranked.search(docs, queries, block_chars=block_chars)) == plain([r[:2] for r in rows], items)


def test_ties_repeats_and_null_keys(spark):
    texts = [(i, "same words here") for i in range(30, 0, -1)] + [(None, "same words here"), (5, "same words here"), (90, "other text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], SCHEMA).repartition(4)
    queries = spark.createDataFrame([(1, "same words"), (1, "same words"), (2, "other"), (3, "same"), (3, "other")], "item_id long, text string")
    got = found(ranked.search(docs, queries))
    assert got == plain(texts, [(1, "same words"), (2, "other"), (3, "other same")])
    assert [d for d, _ in got[1]] == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert found(ranked.search(docs, queries, k=40))[1][-1][0] is None


def test_odd_tables(spark, nobody, odd):
    queries = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(nobody, queries).collect() == []
    assert ranked.search(odd, queries.limit(0)).collect() == []
    got = found(ranked.search(odd, spark.createDataFrame([(1, "key row")], "item_id long, text string")))
    assert got == plain([(r["doc_id"], r["text"]) for r in odd.collect()], [(1, "key row")]) and len(got[1]) == 3


def test_best_positions_reads_little_and_loses_nothing():
    """On lists with clear winners few documents are looked up; on any lists the best are found."""
    rng = random.Random(7)
    for trial in range(30):
        size, n_docs = 5, 400
        pairs = [(d, t) for d in range(n_docs) for t in range(size) if rng.random() < 0.5]
        docs, terms_ = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        impacts = np.array([rng.choice([1, 2, 3]) if trial % 2 else int(rng.paretovariate(0.4) * 10) for _ in pairs])
        lists = ranked.Lists.of(docs, terms_, impacts, size)
        asked, repeats = np.array([0, 2, 4]), np.array([1, 3, 1])
        got, scores = ranked.best_positions(lists, asked, repeats, 0, 10)
        whole = Counter()
        for (d, t), s in zip(pairs, impacts):
            if t in (0, 2, 4):
                whole[d] += int(s) * (3 if t == 2 else 1)
        assert len(set(got.tolist())) == len(got) and all(whole[d] == s for d, s in zip(got.tolist(), scores.tolist()))
        kth = sorted(whole.values(), reverse=True)[9]
        assert {d for d, s in whole.items() if s >= kth} <= set(got.tolist())  # ties at the kth score too
        if not trial % 2:
            assert len(got) < len(whole) // 2
    assert len(ranked.best_positions(lists, asked, repeats, 10**9, 10)[0]) == 0  # not read at all


def test_long_texts(spark):
    word, lines = "w" * 3_000_000, "alpha beta " * 300_000
    docs = spark.createDataFrame([(1, word, "", "", 0), (2, lines, "", "", 0), (3, "alpha", "", "", 0)], SCHEMA)
    queries = spark.createDataFrame([(1, "alpha"), (2, word)], "item_id long, text string")
    assert found(ranked.search(docs, queries)) == plain([(1, word), (2, lines), (3, "alpha")], [(1, "alpha"), (2, word)])

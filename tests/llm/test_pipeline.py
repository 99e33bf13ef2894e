from __future__ import annotations

from collections import Counter

import corpus_pipeline
from lucidex.llm import mixture, rules
from lucidex.llm.common import table
from tests.llm import test_bpe, test_lines, test_shingles
from tests.llm.test_rules import by_hand as rules_by_hand

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in frame.collect()]


def test_each_stage_against_brute_force(spark):
    """Each stage on what the one before kept, and run() on the whole."""
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    every = rows_of(docs)
    good = rows_of(corpus_pipeline.quality_rules(spark, docs, SF))
    found = rules.learn(rules.labelled_statistics(rules.statistics(docs), labels))
    rejected = {r["doc_id"] for r in rules.statistics(docs).filter(found.rejects()).collect()}
    assert sorted(good) == sorted(r for r in every if not rules_by_hand(r[1])[5] and r[0] not in rejected)

    frame = spark.createDataFrame(good, docs.schema)
    cut = rows_of(corpus_pipeline.line_dedup(spark, frame, SF))
    want = test_lines.by_hand(good)
    assert {r[0]: r[1] for r in cut} == {i: w[0] for i, w in want.items()} and len(cut) == len(good)
    assert all(r[4] == len(r[1]) for r in cut)

    frame = spark.createDataFrame(cut, docs.schema)
    single = rows_of(corpus_pipeline.near_dedup(spark, frame, SF))
    groups = test_shingles.groups_by_hand({r[0]: r[1] for r in cut})
    assert sorted(single) == sorted(r for r in cut if groups[r[0]] == r[0])

    frame = spark.createDataFrame(single, docs.schema)
    mixed = rows_of(corpus_pipeline.mix_sources(spark, frame, SF))
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixture.mixture(frame).collect() if r["size"]}
    assert {i: n for i, n in Counter(r[0] for r in mixed).items() if i in copies} == {i: n for i, n in copies.items() if n}

    frame = spark.createDataFrame(mixed, docs.schema)
    ids = corpus_pipeline.bpe_encode(spark, frame, SF).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in ids) == sorted(zip([r[0] for r in mixed], [x[0] for x in test_bpe.by_hand([r[1] for r in mixed])]))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r) for r in ids)


def test_odd_tables(spark, nobody, odd):
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nobody, SF).count() == 0
    kept = corpus_pipeline.near_dedup(spark, odd, SF)
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 7, 8]
    assert corpus_pipeline.line_dedup(spark, odd, SF).count() == 5
    assert corpus_pipeline.mix_sources(spark, odd, SF).columns == corpus_pipeline.COLUMNS


def test_shared_and_missing_ids_lose_no_group(spark):
    """One row of each group stays, whether or not rows have a doc_id of their own."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    rows = [(None, text(1), "en", "a", 1), (None, text(2), "en", "a", 2), (None, text(2), "en", "a", 2), (None, text(3), "en", "b", 3),
            (5, text(4), "en", "a", 4), (5, text(5), "en", "a", 5), (9, text(4), "en", "a", 4), (3, text(6), "en", "a", 6),
            (5, text(6), "en", "a", 6), (None, text(6), "en", "a", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(0, text(1)), (0, text(2)), (0, text(3)), (5, text(4)), (5, text(5)), (3, text(6))])
    for n in (1, 4):
        kept = corpus_pipeline.near_dedup(spark, frame.repartition(n), SF).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == want

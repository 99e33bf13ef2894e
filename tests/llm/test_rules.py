from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lucidex.llm import rules
from tests.llm.samples import words


def by_hand(text: str | None) -> tuple:
    own, text = words(text), text or ""
    windows = [tuple(own[i:i + 3]) for i in range(len(own) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_statistics_against_brute_force(docs, rows):
    stats = rules.statistics(docs).withColumn("failed", rules.base_failed())
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed"))
           for r in stats.collect()}
    assert got == {r[0]: by_hand(r[1]) for r in rows}


def labelled(spark, n=900):
    made = spark.range(n).select(F.col("id").alias("doc_id"), F.expr(
        "CASE WHEN id % 5 = 0 THEN repeat('SHOUT!! NOW ', 30) || id ELSE concat_ws(' ', transform(sequence(1, 60), i -> 'w' || (i * id))) END").alias("text"))
    labels = made.selectExpr("doc_id", "CAST(doc_id % 5 <> 0 AS int) AS quality", "0 AS toxic")
    return made, labels


def test_learns_and_keeps_the_good(spark):
    docs, labels = labelled(spark)
    judged = rules.judged(docs, labels).collect()
    assert all(r["kept"] for r in judged if r["doc_id"] % 5)
    assert not any(r["kept"] for r in judged if r["doc_id"] % 5 == 0)
    kept = rules.keep_good(docs.withColumn("n_words", F.lit("own")), labels)
    assert kept.columns == ["doc_id", "text", "n_words"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in judged if r["kept"]}


def test_statistics_are_counted_once(spark, monkeypatch):
    """The rows that the rules keep come from the written statistics; whole texts aren't counted again."""
    docs, labels = labelled(spark, 100)
    asked, plain = [], rules.statistics
    monkeypatch.setattr(rules, "statistics", lambda rows: (asked.append(1), plain(rows))[1])
    kept = rules.keep_good(docs.withColumn("lang", F.lit(None).cast("string")), labels)
    assert len(asked) == 1
    assert sorted(tuple(r) for r in kept.collect()) == sorted((r["doc_id"], r["text"], None) for r in docs.collect() if r["doc_id"] % 5)


def test_rules_are_ordered_conditions(spark):
    docs, labels = labelled(spark)
    stats = rules.statistics(docs)
    found = rules.learn(rules.labelled_statistics(stats, labels))
    assert found.rules and "-> reject" in str(found.rules[0])
    assert stats.filter(found.rejects()).count() == 180


def test_no_labels_and_odd_tables(spark, nobody, odd):
    _, labels = labelled(spark, 10)
    none = labels.limit(0)
    assert rules.judged(nobody, none).count() == 0
    assert rules.learn(rules.labelled_statistics(rules.statistics(nobody), none)).rules == ()
    judged = rules.judged(odd, labels.withColumn("quality", F.lit(None).cast("int"))).collect()
    assert [r["kept"] for r in judged].count(True) == 0 and len(judged) == 5
    kept = rules.keep_good(odd.withColumn("text", F.expr("concat_ws(' ', transform(sequence(1, 60), i -> 'w' || i))")), none)
    assert kept.columns == odd.columns and kept.count() == 5

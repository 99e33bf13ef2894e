from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from lucidex.llm import mixture
from tests.llm.samples import words


def targets_by_hand(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over


def test_against_brute_force(docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, taken = targets_by_hand(sizes), defaultdict(int)
    biggest = max(len(words(r[1])) for r in rows)
    source = {r[0]: r[3] for r in rows}
    got = mixture.mixture(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest / 2 + 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixture.mixture(docs.repartition(7)).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, None: 3, "d": 7}, {"a": 0, "b": 5}, {"x": 4}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixture.targets(frame).collect()}
    assert got == pytest.approx(targets_by_hand(sizes))


def test_odd_tables(nobody, odd):
    assert mixture.mixture(nobody).count() == 0
    got = mixture.mixture(odd).collect()
    assert len(got) == 5 and all(r["taken"] <= 2 * r["size"] for r in got)


def test_rows_without_or_with_repeated_ids_are_taken_one_by_one(spark):
    """Null and repeated ids, and rows that are equal throughout: each source is within a document of its target."""
    from tests.llm.samples import SCHEMA

    rows = [(i, f"own text {i} " * 3, "en", "a", 0) for i in range(300)]
    rows += [(None, f"other text {i} " * 3, "en", "b", 0) for i in range(300)] + [(7, "same words here", "en", "c", 0)] * 300
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    runs = []
    for parts in (1, 6):
        got = mixture.mix(mixture.sized(spark.createDataFrame(rows, SCHEMA).repartition(parts))).collect()
        runs.append(sorted((str(r["doc_id"]), r["source"], r["size"], r["copies"]) for r in got))
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert runs[0] == runs[1] and len(got) == 900
    wanted = targets_by_hand(size)
    assert target == pytest.approx(wanted)
    assert all(abs(taken[s] - wanted[s]) <= 9 for s in "abc")

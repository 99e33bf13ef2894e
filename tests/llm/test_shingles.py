"""Groups of near texts against all pairs, and the recall of the bands."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lucidex.llm import shingles, simhash
from tests.llm import test_simhash
from tests.llm.samples import words


def grams(text, size=5):
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(own[i:i + size]) for i in range(len(own) - size + 1)} or ({" ".join(own)} if own else set())


def groups_by_hand(texts: dict, threshold: float = 0.8) -> dict:
    """Chains of texts within 4 bits of SimHash or with four fifths of their five-word shingles."""
    prints = {i: test_simhash.by_hand(t) for i, t in texts.items()}
    sets = {i: grams(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b:
                both = len(sets[a] & sets[b])
                near = both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold
                if near or (prints[a] ^ prints[b]).bit_count() <= 4:
                    old, new = sorted((group[a], group[b]), reverse=True)
                    group = {i: new if g == old else g for i, g in group.items()}
    return group


def edited(text, share, rng):
    own = text.split(" ")
    for i in rng.sample(range(len(own)), max(1, round(len(own) * share))):
        own[i] = f"new{rng.randrange(10**6)}"
    return " ".join(own)


def partition(groups):
    return {frozenset(i for i in groups if groups[i] == g) for g in set(groups.values())}


def run(spark, texts):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    placed = simhash.grouped(frame, ["doc_id"])
    return {r["doc_id"]: r["_group"] for r in shingles.regrouped(placed, frame, "doc_id").collect()}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = {0: None, 1: "", 2: "one two", 3: "one two", 4: "same same same same same same"}
    for base in range(12):
        text = " ".join(word() for _ in range(rng.choice([8, 60, 300])))
        for share in (0, 0.005, 0.01, 0.02, 0.03, 0.2):
            texts[len(texts)] = edited(text, share, rng) if share else text
    assert partition(run(spark, texts)) == partition(groups_by_hand(texts))


def test_recall(spark):
    """Pairs of 0.8 and more on five-word shingles: at least nine of ten are in one group (by chance all but two in a thousand)."""
    rng = random.Random(5)
    texts, near, clean = {}, [], []
    for pair in range(300):
        text = " ".join(f"p{pair}w{rng.randrange(900)}" for _ in range(rng.choice([100, 250, 600])))
        other = edited(text, rng.choice([0.01, 0.02, 0.025, 0.08]), rng)
        a, b = grams(text), grams(other)
        likeness = len(a & b) / len(a | b)
        texts[2 * pair], texts[2 * pair + 1] = text, other
        (near if likeness >= 0.8 else clean).append(2 * pair)
    got = run(spark, texts)
    assert len(near) > 150 and sum(got[i] == got[i + 1] for i in near) / len(near) >= 0.98
    bits = {i: (test_simhash.by_hand(texts[i]) ^ test_simhash.by_hand(texts[i + 1])).bit_count() for i in clean}
    assert all(bits[i] <= 4 for i in clean if got[i] == got[i + 1])


def test_many_near_copies_take_few_rounds(spark, monkeypatch):
    """A thousand copies that differ here and there: rows meet leaders, not each other."""
    rng = random.Random(7)
    base = " ".join(f"w{i}" for i in range(200))
    texts = {i: edited(base, 0.01, rng) for i in range(600)}
    pairs = []
    plain = shingles._near
    monkeypatch.setattr(shingles, "_near", lambda met, *rest: (pairs.append(met.count()), plain(met, *rest))[1])
    assert len(set(run(spark, texts).values())) == 1
    assert sum(pairs) < 30 * len(texts)


def test_copies_that_are_near_their_source_only(spark, monkeypatch):
    """Copies near one text and not each other: that text leads, so they are one group without meeting each other."""
    rng = random.Random(8)
    base = " ".join(f"w{i}" for i in range(200))
    texts = {500: base} | {i: edited(base, 0.02, rng) for i in range(300)}
    sets = {i: grams(t) for i, t in texts.items()}
    near = [i for i in range(300) if len(sets[i] & sets[500]) / len(sets[i] | sets[500]) >= 0.8]
    made = []
    plain = shingles._near
    monkeypatch.setattr(shingles, "_near", lambda met, *rest: (made.append(met.count()), plain(met, *rest))[1])
    got = run(spark, texts)
    assert len(near) > 250 and sum(got[i] == got[500] for i in near) >= 0.98 * len(near)
    assert sum(made) < 30 * len(texts)


def test_a_round_takes_its_own_links_only(spark, monkeypatch):
    """Groups are renamed by the links of one round, the whole by those of all; no join is made to be counted."""
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(4000)}" for _ in range(300))
    texts = {i: edited(base, 0.055, rng) for i in range(150)}
    for i in range(150, 170):
        texts[i] = edited(texts[i - 150], 0.01, rng)
    linked, totals, whole, meet = [], [], shingles.components, shingles.meet
    monkeypatch.setattr(shingles, "components", lambda links: (linked.append(links.count()), whole(links))[1])
    monkeypatch.setattr(shingles, "meet", lambda rows, table, key, **more: (totals.append((key, more.get("total"))), meet(rows, table, key, **more))[1])
    assert partition(run(spark, texts)) == partition(groups_by_hand(texts))
    assert len(linked) > 1 and linked[-1] == sum(linked[:-1]), linked
    assert all(n is not None for key, n in totals if key in (["low"], ["high"]))


def test_empty_and_odd(spark):
    assert run(spark, {1: "only one text of some words"}).keys() == {1}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert shingles.regrouped(simhash.grouped(none, ["doc_id"]), none, "doc_id").count() == 0
    got = run(spark, {1: None, 2: "", 3: " \n", 4: "a"})
    assert got[1] == got[2] == got[3] != got[4]


def test_copies_that_are_near_nothing_do_not_meet_each_other(spark, monkeypatch):
    """Copies with so many edits that they share bands but not four fifths: pairs grow with them and not with their square."""
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(4000)}" for _ in range(300))
    texts = {i: edited(base, 0.055, rng) for i in range(150)}
    for i in range(150, 170):  # near one of these copies, which leads nowhere in the first round
        texts[i] = edited(texts[i - 150], 0.01, rng)
    made, plain = [], shingles._near
    monkeypatch.setattr(shingles, "_near", lambda met, *rest: (made.append(met.count()), plain(met, *rest))[1])
    found = run(spark, texts)
    assert partition(found) == partition(groups_by_hand(texts))
    assert sum(made) < 14 * len(texts)


def test_rarest_shingles_of_near_sets_meet(spark):
    rng = random.Random(4)
    sets = {}
    for i in range(60):
        base = rng.sample(range(200), rng.randint(1, 60)) if i % 3 == 0 else list(sets[i - 1])
        sets[i] = set(base if i % 3 == 0 else [t if rng.random() > 0.08 else rng.randrange(300) for t in base])
    rows = [(i, sorted(own)) for i, own in sets.items()]
    told = shingles.rarest(spark.createDataFrame(rows, "row long, own array<int>")).collect()
    heads = {(r["row"], r["token"]) for r in told if r["heads"]}
    every = {(r["row"], r["token"]) for r in told}
    near = [(a, b) for a in sets for b in sets if a != b and (len(sets[a]), a) < (len(sets[b]), b)
            and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 20
    for small, great in near:
        assert any((small, t) in heads and (great, t) in every for t in sets[small]), (small, great)

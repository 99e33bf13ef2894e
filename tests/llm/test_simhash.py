from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from lucidex.llm import graph, simhash
from lucidex.llm.graph import components
from tests.llm.samples import words


def by_hand(text: str | None) -> int:
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(own[i:i + 4]) for i in range(len(own) - 3)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints: dict[int, int], radius: int = 4) -> dict[int, int]:
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


def test_against_brute_force(docs, rows):
    got = {r["doc_id"]: (r["print"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect()}
    prints = {r[0]: by_hand(r[1]) for r in rows}
    assert {i: p for i, (p, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == groups_by_hand(prints)


def test_masks_cover_every_pair():
    masks = simhash.cover_masks(4)
    rng = random.Random(1)
    assert len(masks) == 31
    for _ in range(3000):
        bits = rng.sample(range(64), 4)
        differing = sum(1 << b for b in bits)
        assert any(not (m % (1 << 64)) & differing for m in masks)


def test_large_buckets_go_in_pieces(spark, monkeypatch):
    """Chains in buckets far over the bound stay whole."""
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = random.Random(2)
    value, chain = rng.getrandbits(64), []
    for _ in range(400):
        chain.append(value)
        value ^= 1 << rng.randrange(20)
    chain += [rng.getrandbits(64) for _ in range(100)]
    chain = list(dict.fromkeys(chain))
    signed = [(int(np.uint64(c).view(np.int64)),) for c in chain]
    links = simhash.links(spark.createDataFrame(signed, "print long").repartition(4)).distinct()
    got = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in components(links).collect()}
    want = groups_by_hand(dict(enumerate(chain)))
    sets = lambda pairs: {frozenset(k for k in pairs if pairs[k] == v) for v in set(pairs.values())}
    assert sets({c: got.get(c, c) for c in chain}) == {frozenset(chain[i] for i in s) for s in sets(want)}


@pytest.mark.parametrize("links, want", [
    ([], {}), ([(1, 1)], {}), ([(1, 2), (2, 1), (2, 1)], {1: 1, 2: 1}),
    ([(i, i + 1) for i in range(40)] + [(100, 90)], {**{i: 0 for i in range(41)}, 100: 90, 90: 90})])
def test_components(spark, links, want):
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == want


@pytest.mark.parametrize("links, most", [([(i, 0) for i in range(1, 50)] + [(60 + i, 55) for i in range(5)], 0), ([(i, 0) for i in range(2, 9)] + [(8, 1)], 1)])
def test_components_stop_at_stars(spark, monkeypatch, links, most):
    """Links that are stars take no round, and none is made to see that nothing changes."""
    rounds, plain = [], graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda edges: (rounds.append(1), plain(edges))[1])
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(rounds) <= most and set(found.values()) <= {0, 55} and all(found[a] == found[b] for a, b in links)


def test_odd_tables(nobody, odd):
    assert simhash.near_groups(nobody).count() == 0
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_groups(odd).collect())
    assert got == [(-1, -1), (7, 7), (7, 7), (8, 8), (8, 8)]

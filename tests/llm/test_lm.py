from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lucidex.llm import lm
from tests.llm.samples import words


def tokens(text: str | None) -> list[str]:
    return words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [lm.END]


def by_hand(rows) -> dict[int, tuple]:
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    single, pairs = Counter(), Counter()
    for r in rows:
        if not held[r[0]]:
            own = tokens(r[1])
            single.update(own)
            pairs.update(zip([None, *own], own))
    total, kinds = sum(single.values()), len(single)
    times = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    ending, after = Counter(b for _, b in pairs), defaultdict(list)
    for (a, _), n in pairs.items():
        after[a].append(n)
    pair_d, word_d = lm.discounts(times(pairs.values())), lm.discounts(times(ending.values()))
    take = lambda n, d: d[min(n, 3) - 1] if n else 0.0
    spare = sum(take(n, word_d) for n in ending.values())

    def one(w):
        flat = 1 / (kinds + 1)
        if not pairs:
            return flat
        return (ending[w] - take(ending[w], word_d)) / len(pairs) + spare / len(pairs) * flat

    def two(a, w):
        if not after.get(a):
            return one(w)
        n = pairs[a, w]
        return (n - take(n, pair_d)) / sum(after[a]) + sum(take(k, pair_d) for k in after[a]) / sum(after[a]) * one(w)

    for a in list(after)[:5]:
        assert math.isclose(sum(two(a, w) for w in [*single, "never seen"]), 1, rel_tol=1e-9)
    out = {}
    for r in rows:
        own = tokens(r[1])
        out[r[0]] = (held[r[0]], len(own), sum(single[w] > 0 for w in own), total,
                     sum(math.log10((single[w] + 1) / (total + kinds + 1)) for w in own),
                     sum(math.log10(two(a, w)) for a, w in zip([None, *own], own)))
    return out


@pytest.mark.parametrize("pieces", [None, 64])
def test_against_brute_force(docs, rows, monkeypatch, pieces):
    if pieces:
        for name in ("PIECE_WORDS", "PIECE_PAIRS", "SLICE_TOKENS"):
            monkeypatch.setattr(lm, name, pieces)
    got = {r["doc_id"]: tuple(r)[1:7] for r in lm.train_and_score(docs).collect()}
    want = by_hand(rows)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4]
        assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-9)


def test_mixing_is_one_to_one():
    numbers = np.random.default_rng(0).integers(0, 1 << 63, 10_000, dtype=np.uint64)
    assert (lm.unmix(lm.mix(numbers)) == numbers).all()


def test_odd_tables(spark, nobody, odd):
    assert lm.train_and_score(nobody).count() == 0
    got = lm.train_and_score(odd).collect()
    assert len(got) == 5 and all(r["score"] < 0 for r in got)
    held = spark.createDataFrame([(i, "only held out") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] == 0 for r in lm.train_and_score(held).collect())

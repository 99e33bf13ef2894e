from __future__ import annotations

import hashlib
import random

import pytest

from lucidex.llm import repeats
from tests.llm.samples import SCHEMA


def by_hand(rows) -> dict:
    first: dict[bytes, int] = {}
    for r in sorted(rows, key=lambda r: r[0]):
        data = (r[1] or "").encode()
        for s in range(len(data) - 49):
            first.setdefault(data[s:s + 50], r[0])
    out = {}
    for r in rows:
        data = (r[1] or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - 49):
            if first[data[s:s + 50]] < r[0]:
                gone[s:s + 50] = [True] * 50
        spans, at = [], 0
        for i in range(1, len(data) + 1):
            if i == len(data) or gone[i] != gone[at]:
                if gone[at]:
                    spans.append((at, i))
                at = i
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[r[0]] = (len(data), sum(gone), hashlib.sha256(kept).hexdigest(), spans, kept)
    return out


def sample():
    rng = random.Random(9)
    passage = lambda n: "".join(rng.choice("ab é\n") for _ in range(n))
    shared = [passage(n) for n in (30, 48, 49, 50, 51, 60, 75, 120, 400)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 500, "ab" * 200, "ab" * 30, "short"]
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(1, 5)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [passage(rng.randint(0, 60)), s[a:] if rng.random() < .3 else s]
        texts.append("".join(parts))
    texts += texts[10:20] + [shared[-1], shared[-1][1:], passage(20_000) + shared[-1]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(order[i] * 7, t, "en", "a", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(repeats, "SLICE_BYTES", 700)
        monkeypatch.setattr(repeats, "PIECE_BYTES", 5000)
    rows = sample()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"], [tuple(s) for s in r["spans"]], bytes(r["kept"]))
           for r in repeats.remove_repeats(frame, with_kept=True).collect()}
    assert got == by_hand(rows)
    assert sum(g[1] > 0 for g in got.values()) > 40


def test_odd_tables(nobody, odd):
    assert repeats.remove_repeats(nobody).count() == 0
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in repeats.remove_repeats(odd).collect()) == [
        (-1, 0), (7, 0), (7, 0), (8, 0), (8, 0)]

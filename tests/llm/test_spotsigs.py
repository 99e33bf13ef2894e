from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from lucidex.llm import spotsigs
from tests.llm.samples import words


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def anchors_by_hand(rows):
    seen = Counter(w for r in rows for w in set(words(lower(r[1]))))
    return {w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[:spotsigs.ANCHORS]}


def set_by_hand(text, anchors):
    own = words(lower(text))
    out = set()
    for i, w in enumerate(own):
        if w in anchors:
            chain = [x for x in own[i + 1:] if x not in anchors][:spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
    return out or ({tuple(own)} if own else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_brute_force(docs, rows, partitions):
    anchors = anchors_by_hand(rows)
    ordered = sorted(rows)
    got = {r["doc_id"]: r for r in spotsigs.fingerprints_and_edits(docs, partitions=partitions).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(ordered):
        text, after = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        row = got[r[0]]
        own = set_by_hand(text, anchors)
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(row["fingerprint"]) == 8 * len(own)
        assert row["near_edited"] == pytest.approx(alike(own, set_by_hand(edited, anchors)))
        assert row["near_next"] == pytest.approx(alike(own, set_by_hand(after, anchors)))
    prints = {}
    for r in rows:
        assert prints.setdefault(r[1] or "", got[r[0]]["fingerprint"]) == got[r[0]]["fingerprint"]


def test_classes(docs, rows):
    anchors = anchors_by_hand(rows)
    sets = {r[0]: frozenset(set_by_hand(r[1], anchors)) for r in rows}
    distinct = set(sets.values())
    near = {s: {t for t in distinct if s and t and s != t and alike(s, t) >= 0.8} for s in distinct}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if (sets[a] == sets[b] or sets[b] in near[sets[a]]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in spotsigs.near_classes(docs).collect()}
    assert got == {i: (group[i], len(near[sets[i]])) for i in sets}


def test_pruned_likeness():
    a, b = np.arange(10, dtype=np.uint32), np.arange(5, dtype=np.uint32)
    assert spotsigs.likeness(a, b) == 0.5 and spotsigs.likeness(a, b, 0.8) == 0.0
    assert spotsigs.likeness(b[:0], b[:0]) == 1.0 and spotsigs.likeness(a, b[:0]) == 0.0


def test_odd_tables(spark, nobody, odd):
    assert spotsigs.fingerprints_and_edits(nobody).count() == 0
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["near_next"]) for r in spotsigs.fingerprints_and_edits(odd).collect())
    assert [g[:2] for g in got] == [(False, 7), (False, 7), (False, 8), (False, 8), (True, 0)]
    one = spark.createDataFrame([(5, "only one text")], "doc_id long, text string")
    assert spotsigs.fingerprints_and_edits(one).first()["near_next"] == 1.0


def test_every_language_has_anchors(spark):
    """Nine in ten texts are English; German, texts with commas and texts without common words have signatures, too."""
    def text(i, common, mark=""):
        return " ".join(f"{common[j % len(common)]}{mark} x{(i * 37 + j * 11) % 997} y{(i * 53 + j * 7) % 991}" for j in range(40))

    english = [f"en{k}" for k in range(24)]
    german = ["der", "die", "und", "das"]
    rows = [(i, text(i, english), "en") for i in range(45)] + [(100 + i, text(i, german, ","), "de") for i in range(5)]
    rows += [(200, " ".join(f"q{j}" for j in range(60)), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = spotsigs.common_words(frame, bare=True)
    assert set(english) | set(german) <= set(common)
    signer = spotsigs.Signer(frozenset(w.encode() for w in common), bare=True, sparse=spotsigs.SPARSE)
    assert all(len(signer.signatures(r[1])) >= 15 for r in rows)
    # Punctuation is no part of a word, and one changed word leaves most signatures of a text without anchors.
    assert np.array_equal(signer.signatures(rows[45][1]), signer.signatures(rows[45][1].replace(",", "")))
    bare = spotsigs.Signer(frozenset(), bare=True, sparse=spotsigs.SPARSE)
    assert spotsigs.likeness(bare.signatures(rows[-1][1]), bare.signatures(rows[-1][1].replace("q30", "changed"))) > 0.8

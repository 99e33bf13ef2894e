"""Token alignment against plain Python over every byte."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from lucidex.llm import alignment
from tests.llm.samples import SCHEMA

A, B = alignment.default_tokenizer(), alignment.default_pieces()


def plain_tokens(text):
    """Ids and bytes of both sides by the libraries alone, or None."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders  # noqa: F401

    model = Tokenizer.from_file(A)
    model.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    ids_a, ids_b = model.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    alphabet = alignment.byte_alphabet()
    bytes_a = [bytes(alphabet[c] for c in model.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p := pieces.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def plain(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_shared, groups), with its id pairs."""
    rows, all_pairs = [], []
    for text in texts:
        told = plain_tokens(text) if text else None
        if told is None:
            rows.append((0, 0, 0, 0, 0, ""))
            all_pairs.append([])
            continue
        ids_a, bytes_a, ids_b, bytes_b = told
        owner_a = [i for i, t in enumerate(bytes_a) for _ in t]
        owner_b = [i for i, t in enumerate(bytes_b) for _ in t]
        found = sorted(set(zip(owner_a, owner_b)))
        groups, ga, gb = [], [], []
        for at in range(len(owner_a)):
            end_a = at + 1 == len(owner_a) or owner_a[at + 1] != owner_a[at]
            end_b = at + 1 == len(owner_b) or owner_b[at + 1] != owner_b[at]
            if end_a:
                ga.append(ids_a[owner_a[at]])
            if end_b:
                gb.append(ids_b[owner_b[at]])
            if end_a and end_b:
                groups.append((ga, gb))
                ga, gb = [], []
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), len(found), sum(len(x) * len(y) for x, y in groups),
                     hashlib.sha256(written.encode()).hexdigest()))
        all_pairs.append([(ids_a[i], ids_b[j]) for i, j in found])
    counts = Counter(pair for pairs in all_pairs for pair in set(pairs))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return [row[:5] + (sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), row[5])
            for row, pairs in zip(rows, all_pairs)]


EXTRA = ["▁ piece sign", "\u0000 zero", "ends in space ", "  two before", "naïve café 東京 🙂🙂 <s> </s> <unk> <0x41> <|endoftext|>", "\n\n\t\r\n", " ",
         "é combining", "ﬁ ligature", "a b", "1234567890 12345 3.14159", "don't we'll I'm"]


@pytest.mark.parametrize("block_bytes, split", [(None, True), (2000, True), (None, False)])
def test_against_brute_force(spark, rows, monkeypatch, block_bytes, split):
    if block_bytes:
        monkeypatch.setattr(alignment, "RUN_LINKS", 100)
    table = [r[:2] + (r[2], r[3], r[4]) for r in rows] + [(10_000 + i, t, "en", "x", len(t)) for i, t in enumerate(EXTRA)]
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.aligned(docs, split=split, block_bytes=block_bytes).collect()}
    wanted = plain([r[1] for r in table])
    assert got == {r[0]: w for r, w in zip(table, wanted)}
    assert sum(w[0] > 0 for w in wanted) > 60 and any(r[1] and not w[0] for r, w in zip(table, wanted))


def test_cut_texts_are_the_same():
    a, b = alignment.byte_level(A), alignment.pieces_of(B)
    assert alignment.can_cut(A, B)
    text = " ".join(["one two, three's 4 five-six  seven", "東京 tower 🙂 is\nhigh . really"] * 30)
    whole, parts = alignment.align([text], a, b, None), alignment.align([text], a, b, 17)
    assert len(alignment.cut(" " + text, 17)) > 50 and "".join(alignment.cut(text, 17)) == text
    for side in (0, 1):
        assert whole.ids[side].tolist() == parts.ids[side].tolist()


def test_product_against_numpy():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 3, (7, 5)) * rng.integers(0, 2, (7, 5)), rng.integers(0, 3, (5, 6)) * rng.integers(0, 2, (5, 6))

        def packed(m):
            return alignment.Csr(np.concatenate([[0], np.cumsum((m > 0).sum(1))]), np.nonzero(m)[1], m[m > 0])

        got, dense = alignment.product(packed(x), packed(y), 6), np.zeros((7, 6), int)
        dense[got.row_of(), got.columns] = got.values
        assert (dense == x @ y).all() and len(got.columns) == ((x @ y) > 0).sum()


@pytest.mark.parametrize("shared", [False, True])
def test_links(spark, monkeypatch, shared):
    texts = ["Étion dans çouelle un", None, "", "plain words here", "▁ no tokens"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = alignment.links(docs, shared=shared).collect()
    for i, text in enumerate(texts):
        own = sorted((r["a_at"], r["b_at"], r["a_id"], r["b_id"], r["bytes"]) for r in got if r["doc_id"] == i)
        told = plain_tokens(text) if text else None
        if told is None:
            assert not own
            continue
        ids_a, bytes_a, ids_b, bytes_b = told
        pairs = Counter(zip([i for i, t in enumerate(bytes_a) for _ in t], [i for i, t in enumerate(bytes_b) for _ in t]))
        overlaps = [(x, y, ids_a[x], ids_b[y], n) for (x, y), n in sorted(pairs.items())]
        if shared:
            assert len(own) == plain([text])[0][4] and [r for r in own if r[4]] == overlaps
        else:
            assert own == overlaps


def test_odd_tables(spark, nobody, odd):
    assert alignment.aligned(nobody).collect() == []
    got = alignment.aligned(odd).collect()
    assert len(got) == 5 and sorted((r["doc_id"] or 0, r["n_a"] > 0) for r in got) == [(0, True), (7, False), (7, False), (8, True), (8, True)]
    none = alignment.aligned(odd.filter("doc_id = 7")).first()
    assert (none["n_a"], none["count_sum"], none["groups_sha256"]) == (0, 0, "")

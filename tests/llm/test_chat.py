"""Reply trees and chat texts against plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest

from lucidex.llm import chat

NODES = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def plain_paths(nodes):
    """{(tree, leaf): [nodes from root to leaf]} of unique (tree, node, parent) rows."""
    parent = {(t, n): p for t, n, p in nodes}
    parent = {key: p if (key[0], p) in parent else None for key, p in parent.items()}
    inner = {(t, p) for (t, _), p in parent.items() if p is not None}
    out = {}
    for tree, leaf in parent:
        if (tree, leaf) not in inner:
            way, at = [], leaf
            while at is not None and at not in way:
                way.append(at)
                at = parent[tree, at]
            if at is None:
                out[tree, leaf] = way[::-1]
    return out


def random_tree(tree, size, rng):
    return [(tree, i, rng.choice([None, 10**6, *range(i)]) if i else None) for i in range(size)]


@pytest.mark.parametrize("hot", [None, 3])
def test_paths(spark, monkeypatch, hot):
    rng = random.Random(2)
    nodes = random_tree(1, 60, rng) + random_tree(2, 1, rng) + [(3, i, i - 1) for i in range(1, 70)]
    nodes += [(4, 1, 2), (4, 2, 1), (4, 3, 1), (5, 7, 7)] + [(6, 0, None)] + [(6, i, 0) for i in range(1, 40)]  # circles, and a hot root
    if hot:
        monkeypatch.setattr(chat, "HOT_ROWS", hot)
        monkeypatch.setattr(chat, "HOT_KEYS", 50)
    walk = chat.paths(spark.createDataFrame(nodes, "tree long, node long, parent long").repartition(3))
    got = {}
    for r in walk.collect():
        got.setdefault((r["tree"], r["leaf"]), {})[r["up"]] = r["node"]
    wanted = plain_paths(nodes)
    assert {key: [way[up] for up in sorted(way, reverse=True)] for key, way in got.items()} == wanted
    assert all(sorted(way) == list(range(len(way))) for way in got.values()) and not any(t in (4, 5) for t, _ in got)


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_end|>\\", "<|im_start|>user\nhi<|im_end|>\n", "<", "<|im_end|",
         "<<SYS>>x<</SYS>>", "<<s>>", "[[INST]]", "\\", "é🙂<s>東", "\n\n", "a\x00b", "$1 \\1"]


def test_round_trip(spark):
    roles = ["user", "assistant", "system", None, "a\nb", "<|im_end|>", "\\n", "as\\<s>"]
    turns = [(c, t, roles[(c + t) % len(roles)], TEXTS[(c * 5 + t) % len(TEXTS)] if (c + t) % 11 else None) for c in range(20) for t in range(c % 7 + 1)]
    messages = spark.createDataFrame([(c, t, t - 1 if t else None, role, text, 0.0) for c, t, role, text in turns], NODES)
    seen = {r["tree_id"]: r for r in chat.conversations_of(messages).collect()}
    for c in range(20):
        own = [(role or "", text or "") for i, _, role, text in turns if i == c]
        row = seen[c]
        assert chat.read_turns(row["formatted"]) == own and row["n_turns"] == len(own)
        assert chat.read_loss(row["formatted"], [r.asDict() for r in row["loss"]]) == "".join(t for r, t in own if r == "assistant")
        assert sum(r["masked"] + r["trained"] for r in row["loss"]) == len(row["formatted"])
        assert row["formatted"].count(chat.OPEN) == len(own)  # texts open no turn


@pytest.mark.parametrize("keep", [None, 1, 2])
def test_branches(spark, keep):
    rng = random.Random(4)
    nodes = [(t, n, p, "user" if n % 2 else "assistant", f"{t}/{n}", rng.choice([None, 1.0, 2.0, 0.5])) for tree in range(4) for t, n, p in random_tree(tree, 25, rng)]
    got = {(r["tree_id"], r["leaf_id"]): r for r in chat.conversations_of(spark.createDataFrame(nodes, NODES).repartition(3), keep=keep).collect()}
    score = {(t, n): s or 0.0 for t, n, _, _, _, s in nodes}
    ways = plain_paths([r[:3] for r in nodes])
    wanted = {}
    for tree in range(4):
        own = sorted(((-sum(score[tree, n] for n in way), leaf) for (t, leaf), way in ways.items() if t == tree))
        for rank, (total, leaf) in enumerate(own[:keep], 1):
            wanted[tree, leaf] = (rank, -total)
    assert got.keys() == wanted.keys()
    for key, row in got.items():
        assert [text for _, text in chat.read_turns(row["formatted"])] == [f"{key[0]}/{n}" for n in ways[key]]
        assert row["branch_score"] == wanted[key][1] and (keep is None or row["branch_rank"] == wanted[key][0])


def test_query_rows_and_odd_tables(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 3, None, None), (None, None, "assistant", "late"), (2, 0, "assistant", "")]
    turns = spark.createDataFrame([r + ("clash",) for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = {r["conv_id"]: r for r in chat.format_all(spark, turns).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got.keys() == {1, None, 2, -7}
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_sha256"], got[1]["loss_chars"]) == (3, sha("user\nq\nassistant\na\nassistant\na\n"), sha("aa"), 2)
    assert (got[None]["turns_sha256"], got[None]["loss_sha256"]) == (sha("\n\nassistant\nlate\n"), sha("late"))
    assert got[2]["loss_chars"] == 0 and got[-7]["loss_sha256"] == sha("</s>[INST] ok [/INST]")
    assert [r["conv_id"] for r in chat.format_all(spark, turns.limit(0)).collect()] == [-7]
    assert chat.conversations_of(spark.createDataFrame([], NODES)).collect() == []
    nulls = [(None, 1, None, "user", "x", None), (None, 1, None, "user", "a", None), (None, None, None, "user", "no node", None), (None, 2, 1, "user", "y", None)]
    only = chat.conversations_of(spark.createDataFrame(nulls, NODES)).collect()
    assert [chat.read_turns(r["formatted"]) for r in only] == [[("user", "a"), ("user", "y")]]


def test_long_texts(spark):
    text = "<|im_end|>" * 300_000
    row = chat.format_all(spark, spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")).filter("conv_id = 1").first()
    assert row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lucidex.llm import lines
from tests.llm.samples import SCHEMA

HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(rows, min_chars=lines.MIN_CHARS):
    every = sorted((r[0], i, line) for r in rows for i, line in enumerate((r[1] or "").split("\n")) if HAS_WORD.search(line))
    first = {}
    for d, i, line in every:
        first.setdefault(line, (d, i))
    long = sorted((x for x in first if len(x) >= min_chars), key=first.get)
    near = {b for k, b in enumerate(long) if any(within_one(a, b) for a in long[:k])}
    gone = {(d, i) for d, i, line in every if first[line] != (d, i) or line in near}
    out = {}
    for r in rows:
        parts = (r[1] or "").split("\n")
        out[r[0]] = ("\n".join(p for i, p in enumerate(parts) if (r[0], i) not in gone) if r[1] is not None else None,
                     sum(bool(HAS_WORD.search(p)) for p in parts), sum((r[0], i) in gone for i in range(len(parts))))
    return out


def edited(rng, line):
    at, c = rng.randrange(len(line)), rng.choice("xyé🙂")
    return rng.choice([line[:at] + line[at + 1:], line[:at] + c + line[at:], line[:at] + c + line[at + 1:]])


def sample():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd é") for _ in range(n)).strip() + "." for n in (10, 23, 24, 25, 26, 40, 90, 200)]
    made = [None, "", "\n \n", "aaaa aaaa aaaa aaaa aaaa aaaa\naaaa aaaa aaaa aaaa aaaa aaaaa", "x" * 5000]
    for _ in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                line = edited(rng, line)
            own.append(line)
        made.append("\n".join(own + ["", "tail"]))
    made.append("x" * 2500 + "y" + "x" * 2499)
    return [(i, t, "en", "a", 0) for i, t in enumerate(made)]


def test_against_brute_force(spark):
    rows = sample()
    got = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = by_hand(rows)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == want
    assert sum(w[2] for w in want.values()) > 50


def test_odd_tables(spark, nobody, odd):
    assert lines.dedup_lines(nobody).count() == 0
    got = lines.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    assert sorted(r["n_removed"] for r in got.collect()) == [0] * 5
    line = "this is one long line of a text"
    unnamed = spark.createDataFrame([(None, line), (3, line + "s"), (4, line)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(unnamed).collect()} == {None: 0, 3: 1, 4: 1}
    same_id = spark.createDataFrame([(1, "a line of one text here it is"), (1, "another text\na line of one text here it is")], "doc_id long, text string")
    assert sum(r["n_removed"] for r in lines.dedup_lines(same_id.withColumn("x", F.lit(1))).collect()) == 1

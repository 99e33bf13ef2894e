"""A small table with the awkward cases, and the plain Python that the operators are held against."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(extra: int = 60, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    syllables = "the of and ton an er re ing ble or à é ñ ß 东 🙂".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    texts = [None, "", " \t\n", "one", "one two", "One TWO three", "a b c d", "x" * 3000, "\n\n", "a\n\na\nb\na",
             "same line here\n" * 40, " ".join(["spam"] * 300), "#*$% &|<> " * 30, "tab\tand\x0bline\x0c\r\nends",
             "no\x85break here x", "it's we're I'm you'll he'd we've  two  spaces ", "end <|endoftext|> of <|endoftext|>text"]
    for _ in range(extra):
        lines = [" ".join(word() for _ in range(rng.randint(1, 25))) + "." for _ in range(rng.randint(1, 8))]
        texts.append("\n".join(lines))
    texts += texts[20:30]
    for t in texts[30:40]:
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts.append(" ".join(word() for _ in range(6000)))
    sources = ["b", "a", None, "c", "hot", "hot", "hot"]
    return [(i * 3, t, "en", sources[i % 7], len(t) if t is not None else None) for i, t in enumerate(texts)]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")

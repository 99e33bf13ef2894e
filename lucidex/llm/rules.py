"""Quality rules: decision lists learned by sequential covering, emitted as Spark conditions.

A rule is a conjunction of thresholds on text statistics that foretells bad documents.  It is grown
literal by literal on two thirds of the labelled rows, pruned on the other third, and the rows it
covers are set aside before the next one is grown.  Each step is one aggregate over the binned
statistics, whose result has a fixed number of rows (features times bins).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lucidex.llm.common import UPPER, saved, whole_text, words_of, SPACES

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

#: What the learned conditions look at, from the statistics of a text.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / n_words",
    "duplicate_lines": "n_dup_lines / n_lines",
    "repeated_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "distinct_share": "n_distinct / n_words",
    "exclamation_share": "n_exclamations / n_words",
    "line_length": "n_words / n_lines",
}


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeat_places() -> Column:
    """Where the 3-word windows stand that a text has twice or more.

    Equal windows meet by sorting their hashes; the covered words are counted from the sorted
    positions, so a text of n words costs n log n.
    """
    same = lambda x, other: F.coalesce(x["h"] == F.get("_sorted", other)["h"], F.lit(False))
    again = F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    return F.array_sort(F.transform(again, lambda x: x["i"]))


def statistics(docs: DataFrame) -> DataFrame:
    """The columns of *docs* and the statistics of each whole text (null: no words).

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as the base rules count them, and
    n_lines, n_upper, n_distinct, n_exclamations.  Columns of *docs* with such names are replaced.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_exclamations"]
    kept = [c for c in docs.columns if c not in own]
    text = whole_text()
    words = F.col("_words")
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(
        F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = (
        docs.select(*kept, words_of(text).alias("_words"), lines.alias("_lines"), F.length(text).alias("_chars"),
                    _without(text, SPACES).alias("word_chars"), _without(text, SYMBOLS).alias("_no_symbols"),
                    _without(text, UPPER).alias("_no_upper"), _without(text, "!").alias("_no_marks"))
        .withColumn("_windows", windows)
        .withColumn("_sorted", F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("_places", F.when(F.col("_sorted").isNotNull(), _repeat_places()))
    )
    steps = F.transform("_places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_places", j + 1) - p, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda total, step: total + step)
    numbers = {
        "n_words": F.size(words), "word_chars": F.col("word_chars"), "n_symbols": F.col("_chars") - F.col("_no_symbols"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)), "n_lines": F.size("_lines"), "n_upper": F.col("_chars") - F.col("_no_upper"),
        "n_distinct": F.size(F.array_distinct(words)), "n_exclamations": F.col("_chars") - F.col("_no_marks"),
    }
    # Through a generator, so that a filter on a statistic is not moved below the steps that share its parts.
    return counted.select(*kept, F.inline(F.array(F.struct(*[numbers[c].cast("long").alias(c) for c in own]))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature(name: str) -> Column:
    """A statistic as a number; without words it is zero."""
    return F.coalesce(F.expr(FEATURES[name].replace(" / ", " / nullif(") + ", 0)").cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Literal:
    """A threshold: the feature is above (or else at most) the edge."""

    feature: str
    above: bool
    edge: float
    bin: int

    def column(self) -> Column:
        return feature(self.feature) > self.edge if self.above else feature(self.feature) <= self.edge

    def binned(self) -> Column:
        return F.col(self.feature) > self.bin if self.above else F.col(self.feature) <= self.bin


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    #: How many of the labelled pruning rows that it covers are bad, and how many it covers.
    bad: int
    covered: int

    def column(self) -> Column:
        return _all([x.column() for x in self.literals])

    def __str__(self) -> str:
        told = " AND ".join(f"{x.feature} {'>' if x.above else '<='} {x.edge:.6g}" for x in self.literals)
        return f"{told} -> reject ({self.bad} of {self.covered})"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a document that none covers is kept."""

    rules: tuple[Rule, ...] = field(default=())

    def matched(self) -> Column:
        """The number of the first rule that covers a row of statistics, null where none does."""
        return F.coalesce(*[F.when(rule.column(), F.lit(i + 1)) for i, rule in enumerate(self.rules)], F.lit(None).cast("int"))

    def rejects(self) -> Column:
        return self.matched().isNotNull()


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for one in conditions:
        out = out & one
    return out


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Bad rows kept times the information won about them."""
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def learn(labelled: DataFrame, bins: int = 32, most_rules: int = 8, most_literals: int = 3, precision: float = 0.9,
          support: int = 5) -> DecisionList:
    """The decision list for rows of statistics with ``bad`` (boolean) and ``part`` (0 to 2).

    Parts 1 and 2 grow rules, part 0 prunes them.  A rule joins the list if it covers *support* bad
    rows and is right in *precision* of its cases, both while growing and pruning.  All labelled rows are used; the driver sees counts by
    feature and bin only.  No labelled row, or only good ones: an empty list.
    """
    names = list(FEATURES)
    cuts = [i / bins for i in range(1, bins)]
    # Thresholds to choose from: quantiles of all rows and of the bad ones.
    found = labelled.agg(*[F.percentile_approx(feature(n), cuts, 10_000).alias(n) for n in names], *[
        F.percentile_approx(F.when(F.col("bad"), feature(n)), [0.0, *cuts, 1.0], 10_000).alias(f"bad_{n}") for n in names]).first()
    edges = {n: sorted({*(found[n] or []), *(found[f"bad_{n}"] or [])}) for n in names}
    coded = saved(labelled.select("bad", "part", *[
        sum((F.when(feature(n) > edge, 1).otherwise(0) for edge in edges[n]), F.lit(0)).alias(n) for n in names]), "rules-bins")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in names]))
    left, rules = coded, []
    while len(rules) < most_rules:
        literals: list[Literal] = []
        while len(literals) < most_literals:
            inside = left.filter("part <> 0").filter(_all([x.binned() for x in literals]))
            bars = (inside.select(pairs.alias("x"), "bad").groupBy("x.feature", "x.bin")
                    .agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).collect())
            counts = {(r["feature"], r["bin"]): (r["bad"], r["n"] - r["bad"]) for r in bars}
            bad_all = sum(v[0] for k, v in counts.items() if k[0] == names[0])
            good_all = sum(v[1] for k, v in counts.items() if k[0] == names[0])
            if bad_all < support or not good_all:
                break
            choices = []
            for n in names:
                bad = good = 0
                for b, edge in enumerate(edges[n]):
                    more = counts.get((n, b), (0, 0))
                    bad, good = bad + more[0], good + more[1]
                    choices.append((_gain(bad, good, bad_all, good_all), bad, Literal(n, False, edge, b)))
                    choices.append((_gain(bad_all - bad, good_all - good, bad_all, good_all), bad_all - bad, Literal(n, True, edge, b)))
            choices = [c for c in choices if c[1] >= support]
            if not choices or max(choices, key=lambda c: c[0])[0] <= 0:
                break
            best = max(choices, key=lambda c: (c[0], c[1]))
            # Thresholds that part the rows alike: the one in the middle keeps most distance from both sides.
            alike = [c[2] for c in choices if c[:2] == best[:2] and (c[2].feature, c[2].above) == (best[2].feature, best[2].above)]
            literals.append(alike[len(alike) // 2])
        if not literals:
            break
        prefixes = [_all([x.binned() for x in literals[:k]]) for k in range(1, len(literals) + 1)]
        tried = left.agg(*[F.sum((p & F.col("bad") & c).cast("long")).alias(f"bad{w}{k}") for k, p in enumerate(prefixes)
                           for w, c in ((0, F.col("part") == 0), (1, F.col("part") != 0))],
                         *[F.sum((p & c).cast("long")).alias(f"all{w}{k}") for k, p in enumerate(prefixes)
                           for w, c in ((0, F.col("part") == 0), (1, F.col("part") != 0))]).first()
        worth = [((2 * tried[f"bad0{k}"] - tried[f"all0{k}"]) / max(tried[f"all0{k}"], 1), -k) for k in range(len(prefixes))]
        size = 1 - max(worth)[1]
        k = size - 1
        bad, covered = tried[f"bad0{k}"], tried[f"all0{k}"]
        right = min(bad / max(covered, 1), tried[f"bad1{k}"] / max(tried[f"all1{k}"], 1))
        if bad < 1 or tried[f"bad1{k}"] < support or right < precision:
            break
        rules.append(Rule(tuple(literals[:size]), bad, covered))
        left = left.filter(~prefixes[k])
    return DecisionList(tuple(rules))


def labelled_statistics(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the labelled documents; labels without a document or a quality are left out."""
    marked = labels.select(F.col("doc_id").alias("_labelled"), (F.col("quality") == 0).alias("bad")).filter("_labelled IS NOT NULL AND bad IS NOT NULL")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)).cast("int")
    return stats.join(marked, stats["doc_id"] == marked["_labelled"]).withColumn("part", part)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict per document: base_failed, rule (the first that covers it) and kept.

    Rows are judged one by one, so repeated and null keys don't matter.  A base failure is never kept.
    """
    stats = saved(statistics(docs.select("doc_id", "text")).drop("text"), "rules-stats")
    verdicts = learn(labelled_statistics(stats, labels))
    return (stats.withColumn("base_failed", base_failed()).withColumn("rule", verdicts.matched())
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns and whole texts.

    Statistics are counted once: they are written with the rows, and the rules are learned and applied on that table.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    stats = saved(statistics(docs.select(whole, "doc_id", "text")).drop("text"), "rules-rows")
    verdicts = learn(labelled_statistics(stats.drop("_row"), labels))
    return stats.filter(~base_failed() & ~verdicts.rejects()).select("_row.*")

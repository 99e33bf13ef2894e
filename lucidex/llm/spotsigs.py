"""Document fingerprints by SpotSigs.

The words that most documents of a language have are anchors, and those of all languages are anchors in
every text, so that equal texts have equal fingerprints whatever language they are said to be in.  After
each anchor the next content words (those that are no anchors) form a chain; an anchor with its chain is
a signature, and a document's fingerprint is the set of its signatures.  Sets are compared by Jaccard
likeness, which is pruned by their sizes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lucidex.llm.common import WORD, ascii_lower, saved, whole_text, words_of
from lucidex.llm.graph import components

#: How many of the most common words of a language are anchors, and content words in a chain.
ANCHORS = 24
CHAIN = 2

#: Texts with fewer than one signature in so many words get the chains of all their words.
SPARSE = 20

#: Taken off both ends of bare words.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»‹›“”„‘’‚…–—¡¿·•"

_WORDS = re.compile(WORD)


def common_words(docs: DataFrame, top: int = ANCHORS, bare: bool = False) -> tuple[str, ...]:
    """The *top* words of each language by the number of its documents that have them (A-Z lower-cased; ties by the word).

    Documents without a language are one more, and a table without the column is in one language.
    """
    words = words_of(ascii_lower(whole_text()))
    if bare:
        words = F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION))), lambda w: w != "")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    each = docs.select(lang.alias("lang"), F.explode(F.array_distinct(words)).alias("word"))
    counts = saved(each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "spot-words")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    first = counts.withColumn("_place", place).filter(F.col("_place") <= top)
    return tuple(r["word"] for r in first.select("word").distinct().orderBy("word").collect())


@dataclass(frozen=True)
class Signer:
    """Makes sets of signatures, as sorted 32-bit numbers."""

    anchors: frozenset[bytes]
    chain: int = CHAIN
    #: Words without the punctuation around them.
    bare: bool = False
    #: Below one signature in so many words a text gets the chains of all its words; 0: one signature of the whole text if it has none.
    sparse: int = 0

    def words(self, text: str) -> list[bytes]:
        # Bytes split at ASCII white space only, and lower-case A-Z only.
        low = text.encode().lower()
        if not self.bare:
            return low.split()
        return [w.encode() for w in (x.strip(PUNCTUATION) for x in _WORDS.findall(low.decode())) if w]

    def _chains(self, names: np.ndarray, at: np.ndarray, content: np.ndarray) -> np.ndarray:
        """Signatures of the words *at* with the content words after each."""
        follow = np.searchsorted(content, at, "right")
        full = follow + self.chain <= len(content)
        at, follow = at[full], follow[full]
        out = names[at]
        for k in range(self.chain):
            out = out * np.uint64(0x9E3779B97F4A7C15) + names[content[follow + k]]
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((out >> np.uint64(32)).astype(np.uint32))

    def signatures(self, text: str) -> np.ndarray:
        """A text without any chain has one signature, all of its words; one without words has none."""
        words = self.words(text)
        if not words:
            return np.zeros(0, np.uint32)
        names = np.fromiter(map(crc32, words), np.uint64, len(words))
        anchor = np.fromiter((w in self.anchors for w in words), bool, len(words))
        content = np.flatnonzero(~anchor)
        out = self._chains(names, np.flatnonzero(anchor), content)
        if self.sparse and len(out) * self.sparse < len(words):
            # The chains from anchors are among these.
            every = np.arange(len(words))
            out = self._chains(names, every, content)
            if not len(out):
                out = self._chains(names, every, every)
        return out if len(out) else np.array([crc32(b" ".join(words))], np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard likeness of two sets; 0 without a comparison where sizes alone rule out *at_least*.  Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def told(signatures: np.ndarray) -> str:
    """A fingerprint as text: eight hexadecimal digits a signature."""
    return signatures.astype(">u4").tobytes().hex()


def signature_sets(docs: DataFrame, signer: Signer) -> DataFrame:
    """doc_id and its signatures (array<long>) for every document."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [signer.signatures(t.as_py()).astype(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "signatures"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {key}, signatures array<long>")


def near_classes(docs: DataFrame, threshold: float = 0.8, top: int = ANCHORS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id reached by links of *threshold* or more) and n_links.

    Equal sets are one set first.  Sets are partitioned by length, so that likeness can only reach the
    threshold within a partition or to the next one, and sets meet only by a signature among their
    first few in the order of rarity.  n_links counts the other distinct sets that a set is linked to.
    """
    signer = Signer(frozenset(w.encode() for w in common_words(docs, top)))
    sets = saved(signature_sets(docs, signer).withColumn("print", F.xxhash64("signatures")), "spot-sets")
    distinct = sets.dropDuplicates(["print"]).select("print", "signatures").filter(F.size("signatures") > 0)
    rarity = distinct.select(F.explode("signatures").alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    ranked = (distinct.select("print", F.explode("signatures").alias("signature")).join(rarity, "signature")
              .groupBy("print").agg(F.array_sort(F.collect_list(F.struct("n", "signature"))).alias("_s")))
    size = F.size("_s")
    part = F.floor(F.log(size.cast("double")) / -math.log(threshold) + 1e-9).cast("int")
    # Two sets over the threshold share one of the first size - ceil(threshold * size) + 1.
    first = F.slice(F.transform("_s", lambda s: s["signature"]), F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)
    placed = saved(ranked.select("print", F.transform("_s", lambda s: s["signature"]).alias("signatures"), part.alias("part"), first.alias("first")), "spot-placed")
    keyed = placed.select("print", "part", F.explode("first").alias("signature"), F.size("signatures").alias("size"))
    left = keyed.select(F.col("print").alias("a"), "signature", F.col("size").alias("size_a"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("part").alias("own"))
    right = keyed.select(F.col("print").alias("b"), "signature", "part", F.col("size").alias("size_b"))
    pairs = (left.join(right, ["part", "signature"]).filter((F.col("a") < F.col("b")) | (F.col("own") < F.col("part"))).filter("a <> b")
             .filter((F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-9)).select("a", "b").distinct())
    named = placed.select("print", "signatures")
    checked = (pairs.join(named.toDF("a", "_sa"), "a").join(named.toDF("b", "_sb"), "b")
               .withColumn("both", F.size(F.array_intersect("_sa", "_sb")))
               .filter(F.col("both") >= threshold * (F.size("_sa") + F.size("_sb") - F.col("both")) - 1e-9).select("a", "b"))
    links = saved(checked, "spot-links")
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    groups = components(links).join(counts, "node", "left")
    joined = sets.select("doc_id", "print").join(groups, F.col("print") == F.col("node"), "left").select(
        "doc_id", F.coalesce("component", "print").alias("_class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    least = joined.groupBy("_class").agg(F.min("doc_id").alias("class_id"))
    return joined.join(least, "_class").select("doc_id", "class_id", "n_links")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(signer: Signer, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket, in order, a bucket's last row being the first of the next bucket."""
        open_row = None
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, bucket, ghost, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bucket", "ghost", "text"))):
                own = signer.signatures(text)
                if open_row is not None and open_row[1] == bucket and not open_row[2]:
                    before, _, _, old, signed = open_row
                    edited = _edited(old, text)
                    signed_edited = signer.signatures(edited)
                    row = (before, len(old), hashlib.sha256(edited.encode()).hexdigest(), told(signed), told(signed_edited),
                           likeness(signed, signed_edited), likeness(signed, own))
                    for column, value in zip(out, row):
                        column.append(value)
                if open_row is None or open_row[1] != bucket or not open_row[2]:
                    open_row = (doc, bucket, ghost, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], key_type), pa.array(out[1], pa.int64()), *[pa.array(c, pa.string()) for c in out[2:5]],
                 *[pa.array(c, pa.float64()) for c in out[5:]]],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return run


def fingerprints_and_edits(docs: DataFrame, top: int = ANCHORS, partitions: int | None = None, bare: bool = False, sparse: int = 0) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like they and the next document's are.

    Documents are ordered by doc_id (null last, then by a hash of the text); after the last comes the
    first.  The edited text has the last half of a text replaced by the beginning of the next one.
    Texts are moved once, into ranges of doc_id; the first of each range goes to the range before as
    well.  A null text is empty.  *bare* and *sparse* are the Signer's.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    signer = Signer(frozenset(w.encode() for w in common_words(docs, top, bare)), bare=bare, sparse=sparse)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    cuts = docs.select(place.alias("p")).agg(F.percentile_approx("p", [i / partitions for i in range(1, partitions)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    # How many cuts a doc_id has reached: its bucket.
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= place)) if cuts else F.lit(0)
    heads = sorted(docs.select(bucket.alias("b"), place.alias("p")).groupBy("b").agg(F.min("p").alias("p")).collect())
    # At most one row for each range; a range's first document also ends the range before.
    before = spark.createDataFrame([(h["p"], heads[i - 1]["b"]) for i, h in enumerate(heads)], "_head long, _before int")
    rows = docs.select("doc_id", place.alias("_place"), bucket.cast("int").alias("bucket"), whole_text().alias("text"))
    marked = rows.join(F.broadcast(before), F.col("_place") == F.col("_head"), "left")
    both = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("ghost")))).otherwise(F.array(
        F.struct(F.col("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("ghost"))))
    dealt = (marked.select("doc_id", "_place", "text", F.inline(both)).repartitionById(partitions, F.col("bucket"))
             .sortWithinPartitions("bucket", "ghost", "_place", F.xxhash64("text")).select("doc_id", "bucket", "ghost", "text"))
    field = docs.schema["doc_id"].dataType
    return dealt.mapInArrow(_compare(signer, to_arrow_type(field)), f"doc_id {field.simpleString()}, {_OUT}")

"""Search for any piece of text without reading bodies that can't hold it.

Lower-cased fields are cut into blocks of positions.  A posting says that a gram (one, two or three characters)
begins in a block of a field of a document.  A term stands in one block or over the edge to the next, so a
place can hold it only if all its grams begin in that block or the next one: postings of these grams are
intersected by document, field and block.  What is left is read and looked at, so hits are exact.

Blocks of some megabytes of texts are numbered together, a unit.  A row of the postings is a gram with the numbers of
all its blocks in a unit, and one row of each unit tells whose block each number is.  So rows grow with the distinct
grams of units and not with those of blocks.

Postings are kept by a hash of the gram and sorted by it, texts by a hash of the document and sorted by it, so a
search lists few folders, skips row groups, and reads pages of bodies only where candidates are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lucidex.operators.descriptions import page_of
from lucidex.operators.fetch import fetch_rows
from lucidex.sources.work import written

KEY = ["site_id", "content_id"]
FIELDS = ("title", "excerpt", "body_html")

#: Characters of a block; folders of postings and texts.
BLOCK_CHARS = 1024
FOLDERS = 64

#: Bytes of the texts of a unit; a longer text is a unit of its own.
UNIT_BYTES = 4 << 20

#: Grams of a term that are looked up; the others are left to the look at the text.
MOST_GRAMS = 60

#: Candidates whose ids are handed to the scan itself, which then skips the pages between them.
SCAN_IDS = 1000

TEXTS = ("site_id string, content_id bigint, status string, post_type string, permalink string, published_at timestamp_ntz, "
         "title string, excerpt string, body_html string, seq bigint, folder int")
#: Rows with a gram have places (blocks by their number in the unit); one row of a unit has none but the owner (seq) of each place.
POSTINGS = "gram string, unit bigint, places array<int>, owners array<bigint>, folder int"


def _units(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about as many bytes."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
    number = (np.cumsum(sizes) - sizes) // UNIT_BYTES
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(number)]):
        yield batch.slice(start, end - start)


def _distinct(codes: np.ndarray, places: np.ndarray, most: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a code (below *most*) and a place (below *total*), each once and in order."""
    if most * total < 1 << 63:
        pairs = np.sort(codes * total + places)
        return np.divmod(pairs[np.diff(pairs, prepend=-1) != 0], total)
    order = np.lexsort((places, codes))
    codes, places = codes[order], places[order]
    new = (np.diff(codes, prepend=-1) != 0) | (np.diff(places, prepend=-1) != 0)
    return codes[new], places[new]


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values))


def _postings_of(unit: pa.RecordBatch, block_chars: int) -> Iterator[pa.RecordBatch]:
    names = ["gram", "unit", "places", "owners"]
    seqs = unit.column(0).to_numpy()
    texts = [text for row in zip(*[c.to_pylist() for c in unit.columns[1:]]) for text in row]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    blocks = -(-lengths // block_chars)
    # Between two texts a place is left out, so that no block is next to one of another text.
    first = np.cumsum(blocks + 1) - blocks
    owners = np.repeat(np.repeat(seqs, len(FIELDS)), blocks + 1)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array(seqs[:1]), pa.nulls(1, pa.list_(pa.int32())), _lists(owners, np.zeros(1, np.int64))], names)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    at = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    places = np.repeat(first, lengths) + at // block_chars
    rest = np.repeat(lengths, lengths) - at
    met = np.zeros(0x110000, bool)
    met[chars] = True
    letters = np.flatnonzero(met).astype("<u4")
    numbers = (np.cumsum(met) - 1)[chars]
    codes, base = numbers, len(letters)
    for n in (1, 2, 3):
        if n > 1:
            codes = codes[:-1] * base + numbers[n - 1:]
        whole = rest[:len(codes)] >= n
        own, held = _distinct(codes[whole], places[:len(codes)][whole], base ** n, len(owners))
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        spelled = np.stack([letters[own[starts] // base ** (n - 1 - k) % base] for k in range(n)], axis=1) if len(own) else np.zeros(0, "<u4")
        spelled = spelled.tobytes().decode("utf-32-le")
        grams = pa.array([spelled[i:i + n] for i in range(0, len(spelled), n)], pa.string())
        yield pa.RecordBatch.from_arrays([grams, pa.array(np.full(len(starts), seqs[0])), _lists(held.astype(np.int32), starts),
                                          pa.nulls(len(starts), pa.list_(pa.int64()))], names)


def _run(block_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in _units(batch):
                yield from _postings_of(unit, block_chars)

    return run


def _folder(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FOLDERS)).cast("int")


def postings(texts: DataFrame) -> DataFrame:
    """gram, unit and places of all stored texts, and the owners of each unit; a null text has no places."""
    lowered = texts.select("seq", *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in FIELDS])
    return lowered.mapInArrow(_run(BLOCK_CHARS), POSTINGS.removesuffix(", folder int"))


def build(content: DataFrame, path: str) -> None:
    """Writes the texts of the content and their postings under *path*.

    Texts get a number, by which postings name them.  A gram may be in a great share of the texts: postings are dealt by
    gram and unit, and sorted in each file.
    """
    spark = content.sparkSession
    texts = content.select(*KEY, "status", "post_type", "permalink", "published_at", *FIELDS).withColumn("folder", _folder(*KEY))
    (texts.repartition("folder").sortWithinPartitions("folder", "content_id").withColumn("seq", F.monotonically_increasing_id())
     .write.mode("overwrite").partitionBy("folder").parquet(f"{path}/texts"))
    folder = F.when(F.col("gram").isNull(), F.lit(FOLDERS)).otherwise(_folder("gram"))
    rows = postings(spark.read.schema(TEXTS).parquet(f"{path}/texts")).withColumn("folder", folder)
    spread = F.pmod(F.xxhash64("unit"), F.lit(8))
    (rows.repartition("folder", spread).sortWithinPartitions("folder", "gram", "unit")
     .write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings"))


def grams_of(term: str) -> list[str]:
    """Grams of a lower-cased term that a block, or it and the next, must hold."""
    size = min(3, len(term))
    reach = term[:BLOCK_CHARS]
    return list(dict.fromkeys(reach[i:i + size] for i in range(len(reach) - size + 1)))[:MOST_GRAMS]


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Keys of documents with a place that has all grams of the term."""
    grams = grams_of(term)
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    folders = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in grams])).alias("gram")).select(_folder("gram")).distinct()
    # As many as the term has grams.
    asked = rows.filter(F.col("folder").isin([r[0] for r in folders.collect()]) & F.col("gram").isin(grams))
    bit = F.expr("shiftleft(1L, cast(_at AS int))")
    places = (asked.withColumn("_at", F.array_position(F.array(*[F.lit(g) for g in grams]), F.col("gram")) - 1)
              .select("unit", bit.alias("_bit"), F.explode("places").alias("place"))
              .select("unit", "_bit", F.explode(F.array(F.col("place"), F.col("place") - 1)).alias("place")))
    whole = places.groupBy("unit", "place").agg(F.bit_or("_bit").alias("_bits")).filter(F.col("_bits") == (1 << len(grams)) - 1)
    owners = rows.filter(F.col("folder") == FOLDERS).select("unit", "owners")
    told = whole.groupBy("unit").agg(F.collect_list("place").alias("_places")).join(owners, "unit")
    seqs = told.select(F.explode(F.array_distinct(F.transform("_places", lambda p: F.get("owners", p)))).alias("seq"))
    keys = spark.read.schema(TEXTS).parquet(f"{path}/texts").select("seq", *KEY)
    return keys.join(seqs, "seq", "left_semi").select(*KEY).distinct()


def _texts(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The stored texts of the candidates: by ids in the scan where these are few, and exact in any case."""
    rows = spark.read.schema(TEXTS).parquet(f"{path}/texts")
    if keys.count() <= SCAN_IDS:
        told = keys.select(*KEY, _folder(*KEY).alias("folder")).collect()
        rows = rows.filter(F.col("folder").isin(sorted({r["folder"] for r in told})) & F.col("content_id").isin(sorted({r["content_id"] for r in told}))
                           if told else F.lit(False))
    return fetch_rows(rows, keys, KEY)


def hits(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Published documents whose title, excerpt or body holds the term; all of them for an empty one."""
    needle = term.lower()
    rows = spark.read.schema(TEXTS).parquet(f"{path}/texts")
    if needle:
        rows = _texts(spark, path, written(candidates(spark, path, needle), "search-candidates"))
        found = F.lit(False)
        for column in FIELDS:
            found = found | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(needle))
        rows = rows.filter(found)
    return rows.filter(F.col("status") == "publish").select(*KEY, "title", "post_type", "permalink", "published_at")


def search(spark: SparkSession, path: str, term: str, page: int, size: int) -> DataFrame:
    """What :func:`descriptions.search` finds, by the index; texts are looked at once, for the page and the total."""
    return page_of(written(hits(spark, path, term), "search-hits"), page, size if size > 0 else 50)

"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark, each distinct word is encoded once, and its ids are joined back
to the places where it stands.  Decoding joins ids to pieces, again once for each distinct word.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lucidex.llm.blocks import read_block, token_blocks
from lucidex.llm.common import give_back, release, saved, settings, step_settings, whole_text, work_path

#: How byte-level BPE cuts a text into words, and the token that stands for itself.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

#: Words of a block that are put together at a time.
SLICE_WORDS = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def split_words(text: Column) -> Column:
    """The words of a text in order; they join to the text again."""
    around = r"(?=<\|endoftext\|>)|(?<=<\|endoftext\|>)"
    plain = F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))
    parted = F.flatten(F.transform(F.split(text, around), lambda part: F.when(part == SPECIAL, F.array(part)).otherwise(
        F.regexp_extract_all(part, F.lit(SPLIT), F.lit(0)))))
    return F.when(F.contains(text, F.lit(SPECIAL)), parted).otherwise(plain)


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_padding()
    loaded.no_truncation()
    return loaded


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """Ids of each row's word, also as little-endian 32-bit numbers (word, ids, stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(tokenizer)
        for batch in batches:
            found = model.encode_batch(batch.column("word").to_pylist(), add_special_tokens=False)
            ids = [one.ids for one in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([np.array(one, "<u4").tobytes() for one in ids], pa.binary())], ["word", "ids", "stream"])
        give_back()

    return words.select("word").mapInArrow(run, "word string, ids array<int>, stream binary")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces(spark: SparkSession, tokenizer: str) -> DataFrame:
    """The id-to-piece table (id, piece as bytes); as many rows as the vocabulary has."""
    with open(tokenizer, encoding="utf-8") as file:
        told = json.load(file)
    table = dict((i, piece) for piece, i in told["model"]["vocab"].items())
    bytes_of = byte_alphabet()
    rows = [(i, bytearray(bytes_of[c] for c in piece)) for i, piece in table.items()]
    rows += [(t["id"], bytearray(t["content"].encode())) for t in told["added_tokens"] if t["id"] not in table]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(rows: DataFrame, key: list[str], tokenizer: str, ids: str = "ids") -> DataFrame:
    """The bytes of each row's ids (key, decoded); rows without ids give no row.

    The pieces are broadcast: their number is the size of the vocabulary.
    """
    placed = rows.select(*key, F.posexplode(ids).alias("_at", "id"))
    joined = placed.join(F.broadcast(pieces(rows.sparkSession, tokenizer)), "id")
    return (joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", "piece"))).alias("_pieces"))
            .select(*key, F.aggregate("_pieces", F.lit(b""), lambda done, p: F.concat(done, p["piece"])).alias("decoded")))


def _joined(keys: list[str], with_ids: bool, schema: pa.Schema):
    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(words.column("number").to_numpy(), kind="stable") if words.num_rows else np.zeros(0, np.int64)
        ids = words.column("ids").combine_chunks().take(pa.array(order))
        other = words.column("decoded").combine_chunks().take(pa.array(order))
        for docs, numbers, own_words in zip(*(blocks.column(c) for c in ("docs", "numbers", "words"))):
            block = read_block(docs.as_py(), numbers.as_py())
            decoded = pc.if_else(pc.is_valid(other), other, own_words.values.cast(pa.binary()))
            results = [[], [], [], []]
            first, total = 0, len(block.offsets) - 1
            while first < total:
                last = int(np.searchsorted(block.offsets, block.offsets[first] + SLICE_WORDS, "right")) - 1
                last = min(max(last, first + 1), total)
                place = pa.array(block.numbers[block.offsets[first]:block.offsets[last]])
                ends = block.offsets[first:last + 1] - block.offsets[first]
                streams = []
                for values in (ids, decoded):
                    taken = values.take(place)
                    if isinstance(taken, pa.ChunkedArray):
                        taken = taken.combine_chunks()
                    cuts = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4)[ends] if len(taken) else np.zeros(len(ends), np.int64)
                    streams.append((memoryview(taken.buffers()[2] or b""), cuts))
                for i in range(last - first):
                    (a, ca), (b, cb) = streams
                    own = a[ca[i]:ca[i + 1]]
                    results[0].append(len(own) // 4)
                    results[1].append(hashlib.sha256(own).hexdigest())
                    results[2].append(hashlib.sha256(b[cb[i]:cb[i + 1]]).hexdigest())
                    if with_ids:
                        results[3].append(np.frombuffer(own, "<u4").astype(np.int32))
                first = last
            columns = [block.keys.column(k) for k in keys] + [
                pa.array(results[0], pa.int64()), pa.array(results[1], pa.string()), pa.array(results[2], pa.string())]
            if with_ids:
                columns.append(pa.array(results[3], pa.list_(pa.int32())))
            out.append(pa.Table.from_arrays(columns, schema=schema))
            del results, columns, block, decoded
        give_back()
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def encode(docs: DataFrame, tokenizer: str | None = None, keys: tuple[str, ...] = ("doc_id",), with_ids: bool = False,
           block_bytes: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """Per document its keys, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids.

    A null text is an empty one: no tokens, the digests of nothing.  Repeated rows are encoded each.
    Columns other than the keys and ``text`` are not read.

    The packed texts are written bucketed by block, so that they don't move again: the ids of a
    block's distinct words are shuffled to them.  Smaller blocks (*block_bytes*) and Arrow batches
    (*batch_bytes*) take less memory of a worker and more disk, as blocks share words.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    keys = list(keys)
    name = f"lucidex_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, step_settings(batch_bytes)):
        (token_blocks(docs, keys, split_words(whole_text()), block_bytes).write.option("path", work_path(spark, "bpe-blocks"))
         .option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name))
    blocks = spark.table(name)
    placed = blocks.select("block", F.posexplode("words").alias("number", "word"))
    coded = saved(encode_words(placed.select("word").distinct(), tokenizer), "bpe-words")
    texts = decode(coded, ["word"], tokenizer)
    # A block has its words, so what decodes to the word itself isn't sent there again.
    other = F.when(F.col("decoded") != F.col("word").cast("binary"), F.col("decoded")).alias("decoded")
    table = saved(coded.join(texts, "word").select("word", F.col("stream").alias("ids"), other), "bpe-table")
    release(coded)
    back = saved(placed.join(table, "word").select("block", "number", "ids", "decoded"), "bpe-back")
    release(table)
    types = {f.name: f.dataType.simpleString() for f in docs.select(*keys).schema}
    spec = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
                     + ["ids array<int>"] * with_ids)
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(spec))
    return (blocks.select("block", "docs", "numbers", "words").groupBy("block").cogroup(back.groupBy("block"))
            .applyInArrow(_joined(keys, with_ids, schema), spec))


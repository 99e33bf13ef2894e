"""Token tables by block: a block's distinct words once, its texts as numbers into them.

A block is what one task read, cut at a bound in bytes.  Later steps look up a block's few distinct
words and not each occurrence, and texts are split only once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

#: Bytes of words, with four for each as an offset, after which a block is closed.
BLOCK_BYTES = 64 << 20

SCHEMA = "block long, docs binary, numbers binary, words array<string>, counts array<long>"


@dataclass
class Block:
    """The documents of a block: key, word offsets (one more than documents) and word numbers."""

    keys: pa.Table
    offsets: np.ndarray
    numbers: np.ndarray


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read_block(docs: bytes, numbers: bytes) -> Block:
    table = pa.ipc.open_stream(docs).read_all()
    offsets = np.concatenate([[0], np.cumsum(table.column("length").to_numpy())]).astype(np.int64)
    planes = pa.decompress(numbers, 4 * int(offsets[-1]), codec="zstd", asbytes=True) if offsets[-1] else b""
    told = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    return Block(table.drop(["length"]), offsets, told)


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), np.diff(offsets)


def _close(parts: list[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]], name: int) -> pa.RecordBatch:
    """Parts: keys, the part's distinct words, its word numbers among these, and words per document."""
    coded = pa.concat_arrays([p[1] for p in parts]).dictionary_encode()
    size = len(coded.dictionary)
    of_block = np.split(coded.indices.to_numpy(zero_copy_only=False), np.cumsum([len(p[1]) for p in parts])[:-1])
    counts = np.zeros(size, np.int64)
    for part, own in zip(parts, of_block):
        counts[own] += np.bincount(part[2], minlength=len(own))
    # Frequent words get small numbers, which compress better.
    order = np.argsort(-counts, kind="stable")
    place = np.empty(size, np.int32)
    place[order] = np.arange(size, dtype=np.int32)
    numbers = np.concatenate([place[own][part[2]] for part, own in zip(parts, of_block)])
    docs = pa.Table.from_batches([p[0] for p in parts]).append_column(
        "length", pa.array(np.concatenate([p[3] for p in parts]), pa.int32()))
    # Byte by byte of equal weight: the high ones are mostly zero.
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()
    words = coded.dictionary.take(pa.array(order))
    return pa.RecordBatch.from_arrays([
        pa.array([name], pa.int64()), pa.array([_ipc(docs)], pa.binary()), pa.array([pa.compress(planes, codec="zstd", asbytes=True)], pa.binary()),
        pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), words),
        pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(counts[order]))],
        ["block", "docs", "numbers", "words", "counts"])


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    prefix = (task.partitionId() if task else 0) << 24
    parts, held, made = [], 0, 0
    for batch in batches:
        # A copy: a slice would hold the batch's words too.
        keys = batch.drop_columns(["words"]).take(pa.array(np.arange(batch.num_rows, dtype=np.int32)))
        flat, lengths = _flat(batch.column("words"))
        coded = flat.dictionary_encode()  # the words themselves aren't held
        parts.append((keys, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lengths))
        held += flat.nbytes
        if held >= limit:
            yield _close(parts, prefix + made)
            parts, held, made = [], 0, made + 1
    if parts:
        yield _close(parts, prefix + made)


def token_blocks(docs: DataFrame, keys: list[str], words: Column, block_bytes: int | None = None) -> DataFrame:
    """One row per block: its documents packed, its distinct words (frequent first) and their counts.

    An empty table gives no blocks.  Names of blocks hold only for this execution: save the result.
    """
    limit = block_bytes or BLOCK_BYTES
    return docs.select(*keys, words.alias("words")).mapInArrow(lambda batches: _pack(batches, limit), SCHEMA)

"""Removal of long repeated byte strings by distributed prefix doubling.

A string of 2n bytes is named by the names of its two halves, so names of growing strings are made in
doubling steps, as a suffix array is.  Positions are compared over the whole corpus in rounds, and a
round drops those whose string is found in one document only:

1. Strings of 24 bytes, at anchors.  An anchor is the least name in some window of 27 positions, so
   every string of 50 bytes holds an anchor, and equal strings hold equal ones.  Only starts from
   which an anchor that several documents have is in reach go on.
2. Strings of 50 bytes at those starts.  For each the smallest doc_id that has it is found.

Texts stay in blocks and don't move.  A block sends the sorted names of its positions by piece of the
names; the task that has a piece sorts what all blocks sent and answers with one bit a name.  So no
task sees more than a piece or a block, however often a string is found.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lucidex.llm.common import STEP_SETTINGS, saved, settings, whole_text, work_path

LENGTH = 50
SEED_LENGTH = 24
WINDOW = LENGTH - SEED_LENGTH + 1

#: Bytes of text in a block, bytes named at a time (which then stay in a processor's cache), and bytes
#: of corpus for each piece of the names.
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 18
PIECE_BYTES = 24 << 20

BLOCK_SCHEMA = "block string, ids array<long>, sizes array<int>, text binary, first array<long>, second array<long>"

_U = np.uint64
_PAD = 64


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    prefix, made, parts, held = task.partitionId() if task else 0, 0, [], 0

    def close() -> pa.RecordBatch:
        docs = pa.Table.from_batches(parts).sort_by([("doc_id", "ascending")])
        texts = docs.column("text").to_pylist()
        one = lambda name: pa.array([docs.column(name).to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{prefix}-{made}"]), one("doc_id"), pa.array([list(map(len, texts))], pa.list_(pa.int32())),
             pa.array([pa.compress(b"".join(texts), codec="zstd", asbytes=True)], pa.binary()), one("first"), one("second")],
            ["block", "ids", "sizes", "text", "first", "second"])

    for batch in batches:
        parts.append(batch)
        held += batch.column("text").nbytes
        if held >= BLOCK_BYTES:
            yield close()
            parts, held, made = [], 0, made + 1
    if parts:
        yield close()


class Texts:
    """A block's texts one after the other, ordered by doc_id (null last)."""

    def __init__(self, row: dict):
        ids = row["ids"]
        self.known = np.array([i is not None for i in ids], bool)
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        total = int(self.starts[-1])
        self.bytes = np.frombuffer(pa.decompress(row["text"], total, codec="zstd", asbytes=True) if total else b"", np.uint8)

    def slices(self) -> Iterator[tuple[int, int]]:
        first = 0
        while first < len(self.sizes):
            last = int(np.searchsorted(self.starts, self.starts[first] + SLICE_BYTES, "right")) - 1
            last = min(max(last, first + 1), len(self.sizes))
            yield first, last
            first = last


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def _name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of a string from those of its parts."""
    x = left * _U(0x9E3779B97F4A7C15)
    x += right
    return _mixed(x)


_BYTE_NAMES = _mixed((np.arange(256, dtype=_U) + _U(1)) * _U(0xD1B54A32D192ED03))


def _sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over every window, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = take(x[:-reach], x[reach:])
        reach *= 2
    return take(x[:len(x) - (width - reach)], x[width - reach:]) if reach < width else x


def _doubled(texts: Texts, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the strings of 8 and 16 bytes at each byte of a slice, which is padded at both ends."""
    padded = np.zeros(end - begin + 2 * _PAD, np.uint8)
    padded[_PAD:_PAD + end - begin] = texts.bytes[begin:end]
    names = _BYTE_NAMES[padded]
    for reach in (1, 2, 4):
        names = _name(names[:-reach], names[reach:])
    return names, _name(names[:-8], names[8:])


def anchors(texts: Texts, used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice the anchors' positions and names."""
    for first, last in texts.slices():
        begin, end = int(texts.starts[first]), int(texts.starts[last])
        eight, sixteen = _doubled(texts, begin, end)
        seeds = _name(sixteen[:-8], eight[16:])
        least = _sliding(seeds, WINDOW, np.minimum)
        # A position is an anchor if it is the least of one of the windows that it is in.
        chosen = _sliding(least, WINDOW, np.maximum) == seeds[WINDOW - 1:WINDOW - 1 + len(least) - WINDOW + 1]
        at = np.flatnonzero(chosen) + WINDOW - 1 - _PAD
        at = at[(at >= 0) & (at < end - begin)] + begin
        doc = np.searchsorted(texts.starts, at, "right") - 1
        good = used[doc] & (at + SEED_LENGTH <= texts.starts[doc + 1]) & (texts.sizes[doc] >= LENGTH)
        at = at[good]
        yield at, seeds[at - begin + _PAD]


def _pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(packed: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)


def _squeeze(values: np.ndarray) -> bytes:
    wide = values.dtype.itemsize
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, wide).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(packed: bytes, size: int, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    planes = pa.decompress(packed, size * wide, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(wide, size).T).view(kind).ravel()


SENT = "block string, piece int, size long, names binary, docs binary"


def _send(block: str, names: np.ndarray, docs: np.ndarray, bits: int, name_bits: int) -> pa.Table:
    """Sorted names by piece, each with a number."""
    pieces = (names >> _U(name_bits - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    cuts = np.searchsorted(pieces, np.arange((1 << bits) + 1))
    own = [p for p in range(1 << bits) if cuts[p + 1] > cuts[p]]
    return pa.table({
        "block": pa.array([block] * len(own), pa.string()), "piece": pa.array(own, pa.int32()),
        "size": pa.array([cuts[p + 1] - cuts[p] for p in own], pa.int64()),
        "names": pa.array([_squeeze(np.diff(names[cuts[p]:cuts[p + 1]], prepend=_U(0))) for p in own], pa.binary()),
        "docs": pa.array([_squeeze(docs[cuts[p]:cuts[p + 1]]) for p in own], pa.binary())})


def _answer(kind: str, judge):
    """Sorts all that was sent for a piece and answers each block with a bit a name."""

    def run(group: pa.Table) -> pa.Table:
        sizes = group.column("size").to_pylist()
        names = np.concatenate([np.cumsum(_unsqueeze(n, s, _U), dtype=_U) for n, s in zip(group.column("names").to_pylist(), sizes)])
        docs = np.concatenate([_unsqueeze(d, s, np.int64) for d, s in zip(group.column("docs").to_pylist(), sizes)])
        order = np.argsort(names, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]]))
        flags = np.empty(len(names), bool)
        flags[order] = judge(docs[order], begins)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return pa.table({
            "block": group.column("block"), "kind": pa.array([kind] * len(sizes)), "piece": group.column("piece"),
            "bits": pa.array([_pack_bits(flags[cuts[i]:cuts[i + 1]]) for i in range(len(sizes))], pa.binary()),
            "size": group.column("size")})

    return run


TOLD = "block string, kind string, piece int, bits binary, size long"


def _shared(docs: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A block sends 1 for a name that it has in several documents; else several blocks must send it."""
    lengths = np.diff(np.concatenate([begins, [len(docs)]]))
    return np.repeat((lengths > 1) | (np.maximum.reduceat(docs, begins) > 0), lengths)


def _earlier(docs: np.ndarray, begins: np.ndarray) -> np.ndarray:
    lengths = np.diff(np.concatenate([begins, [len(docs)]]))
    return docs > np.repeat(np.minimum.reduceat(docs, begins), lengths)


class _Told:
    """What a block has been told so far."""

    def __init__(self, table: pa.Table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["piece"]))
        self.flags = {}
        for kind in ("copies", "shared", "earlier"):
            own = [_flags(r["bits"], r["size"]) for r in rows if r["kind"] == kind]
            self.flags[kind] = np.concatenate(own) if own else np.zeros(0, bool)

    def copies(self, texts: Texts) -> np.ndarray:
        return self.flags["copies"] if len(self.flags["copies"]) else np.zeros(len(texts.ids), bool)


def _block(blocks: pa.Table) -> tuple[str, Texts]:
    row = blocks.to_pylist()[0]
    return row["block"], Texts(row)


def _send_seeds(bits: int, name_bits: int):
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({f: pa.array([], t) for f, t in _SENT_TYPES.items()})
        block, texts = _block(blocks)
        used = texts.known & ~_Told(told).copies(texts)
        names, docs = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for at, found in anchors(texts, used):
            names.append(found >> _U(64 - name_bits))
            docs.append(np.searchsorted(texts.starts, at, "right") - 1)
        names, docs = np.concatenate(names), np.concatenate(docs)
        order = np.argsort(names, kind="stable")
        names, docs = names[order], docs[order]
        begins = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
        several = np.maximum.reduceat(docs, begins) != docs[begins] if len(names) else np.zeros(0, bool)
        return _send(block, names[begins], several.astype(np.int64), bits, name_bits)

    return run


class _Strings:
    """Strings of 50 bytes of a block with an anchor that several documents have, in order of their names.

    ``starts`` are in order of the text; ``order`` sorts them by name, ``docs`` are the documents in that order,
    ``kinds`` the distinct names, ``group`` which of these each string has, and ``first`` the first document of each.
    Documents stand in the order of their ids, so the first has the smallest.
    """

    def __init__(self, texts: Texts, told: _Told, name_bits: int):
        used = texts.known & ~told.copies(texts)
        found = list(anchors(texts, used))
        kinds, at = np.unique(np.concatenate([np.zeros(0, _U), *[f[1] for f in found]]) >> _U(64 - name_bits), return_inverse=True)
        shared = told.flags["shared"][at] if len(kinds) else np.zeros(0, bool)
        del kinds, at
        starts, names, done = [np.zeros(0, np.int32)], [np.zeros(0, _U)], 0
        for (first, last), (positions, _) in zip(texts.slices(), found):
            own = positions[shared[done:done + len(positions)]]
            done += len(positions)
            begin, end = texts.starts[first], texts.starts[last]
            doc = np.searchsorted(texts.starts, own, "right") - 1
            low = np.maximum(own - WINDOW + 1, texts.starts[doc])
            high = np.minimum(own, texts.starts[doc + 1] - LENGTH) + 1
            cover = np.zeros(end - begin + 1, np.int32)
            ok = low < high
            np.add.at(cover, low[ok] - begin, 1)
            np.add.at(cover, high[ok] - begin, -1)
            s = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            if not len(s):
                continue
            sixteen = _doubled(texts, int(begin), int(end))[1][_PAD:]
            skip = LENGTH - 32
            left = _name(sixteen[s], sixteen[s + 16])
            right = _name(sixteen[s + skip], sixteen[s + skip + 16])
            starts.append((s + begin).astype(np.int32 if texts.starts[-1] < 1 << 31 else np.int64))
            names.append(_name(left, right))
        del found, shared
        self.starts = np.concatenate(starts)
        joined = np.concatenate(names)
        del starts, names
        self.order = np.argsort(joined)
        joined = joined[self.order]
        new = np.concatenate([[True], joined[1:] != joined[:-1]]) if len(joined) else np.zeros(0, bool)
        self.kinds = joined[new]
        del joined
        self.group = np.cumsum(new, dtype=np.int32) - 1
        self.docs = (np.searchsorted(texts.starts, self.starts, "right") - 1).astype(np.int32)[self.order]
        begins = np.flatnonzero(new)
        self.first = np.minimum.reduceat(self.docs, begins) if len(begins) else np.zeros(0, np.int32)


def _send_strings(bits: int, name_bits: int):
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.table({f: pa.array([], t) for f, t in _SENT_TYPES.items()})
        block, texts = _block(blocks)
        strings = _Strings(texts, _Told(told), name_bits)
        return _send(block, strings.kinds, texts.ids[strings.first], bits, 64)

    return run


_SENT_TYPES = {"block": pa.string(), "piece": pa.int32(), "size": pa.int64(), "names": pa.binary(), "docs": pa.binary()}
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>, kept binary"


def _remove(name_bits: int, with_kept: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        if blocks.num_rows:
            _, texts = _block(blocks)
            known = _Told(told)
            cover = np.zeros(len(texts.bytes) + 1, np.int32)
            strings = _Strings(texts, known, name_bits)
            again = np.empty(len(strings.starts), bool)
            if len(again):
                again[strings.order] = known.flags["earlier"][strings.group] | (texts.ids[strings.docs] > texts.ids[strings.first][strings.group])
            starts = strings.starts[again]
            del strings, again
            cover[starts] += 1  # no start stands twice
            cover[starts + LENGTH] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            copies = known.copies(texts)
            for i in range(len(texts.ids)):
                own = texts.bytes[texts.starts[i]:texts.starts[i + 1]]
                cut = np.full(len(own), True) if copies[i] and len(own) >= LENGTH else gone[texts.starts[i]:texts.starts[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
                kept = own[~cut].tobytes() if len(edges) else own.tobytes()
                out["doc_id"].append(int(texts.ids[i]) if texts.known[i] else None)
                out["n_bytes"].append(len(own))
                out["n_removed"].append(len(own) - len(kept))
                out["n_spans"].append(len(edges) // 2)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                out["kept"].append(kept if with_kept else None)
        return pa.table(out, schema=pa.schema([
            ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()), ("spans", span), ("kept", pa.binary())]))

    return run


def _copies(blocks: DataFrame) -> DataFrame:
    """Per block a bit a document: does its whole text stand in a document with a smaller doc_id?"""
    docs = blocks.select("block", F.posexplode(F.arrays_zip("ids", "first", "second")).alias("at", "d")).select("block", "at", "d.*")
    least = docs.groupBy("first", "second").agg(F.min("ids").alias("least"))
    # Copies of one text all meet its one row in the other table, so a hot text can be split.
    judged = docs.join(least, ["first", "second"]).select("block", "at", F.coalesce(F.col("ids") > F.col("least"), F.lit(False)).alias("copy"))

    def bits(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("at").to_numpy())
        flags = group.column("copy").to_numpy(zero_copy_only=False)[order]
        return pa.table({"block": group.column("block").slice(0, 1), "kind": ["copies"], "piece": pa.array([0], pa.int32()),
                         "bits": [_pack_bits(flags)], "size": pa.array([len(flags)], pa.int64())})

    return judged.groupBy("block").applyInArrow(bits, TOLD)


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, if wanted, kept.

    A byte of the UTF-8 text goes if a 50-byte string over it also starts in a document with a smaller
    doc_id.  A null or empty text has no bytes.  A document without doc_id loses nothing and takes
    nothing; rows that share a doc_id take nothing from each other.
    """
    spark = docs.sparkSession
    name = f"lucidex_texts_{uuid.uuid4().hex}"
    text = whole_text()
    narrow = docs.select(F.col("doc_id").cast("long"), text.cast("binary").alias("text"), F.xxhash64(text).alias("first"),
                         F.xxhash64(F.lit(1), text).alias("second"))
    with settings(spark, STEP_SETTINGS):
        (narrow.mapInArrow(_pack, BLOCK_SCHEMA).write.option("path", work_path(spark, "repeat-texts")).option("compression", "zstd")
         .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name))
    blocks = spark.table(name)
    total = blocks.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(total, 1) / PIECE_BYTES)))
    # Seed names need not be exact: one taken for another only lets a start go on to the next round.
    name_bits = min(64, math.ceil(math.log2(max(total, 2))) + 14)
    told = saved(_copies(blocks), "repeat-copies")
    grouped = blocks.groupBy("block")
    seeds = grouped.cogroup(told.groupBy("block")).applyInArrow(_send_seeds(bits, name_bits), SENT)
    shared = saved(seeds.groupBy("piece").applyInArrow(_answer("shared", _shared), TOLD), "repeat-shared")
    told = told.unionByName(shared)
    strings = grouped.cogroup(told.groupBy("block")).applyInArrow(_send_strings(bits, name_bits), SENT)
    earlier = saved(strings.groupBy("piece").applyInArrow(_answer("earlier", _earlier), TOLD), "repeat-earlier")
    return grouped.cogroup(told.unionByName(earlier).groupBy("block")).applyInArrow(_remove(name_bits, with_kept), OUT)

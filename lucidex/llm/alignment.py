"""Alignment of two tokenizers over the same bytes, by products of sparse matrices.

A token covers a run of bytes, so a text gives a token-byte incidence matrix for each tokenizer.  With A
and B in compressed rows, the product A·Bᵀ has an entry for each pair of tokens that share a byte (its value:
how many), and the product of the token-group matrices has one for each pair in a group, where groups are
cut at the byte offsets at which tokens of both sides end.  Products go row by row after Gustavson: the rows
of the second matrix that an entry of the first one names are gathered and merged.

Texts are split at spaces between words, which no token of either side crosses; all that is said of a text is
a sum, a join or a union over its pieces, so each distinct piece of a batch is encoded and aligned once.  (Where
a vocabulary allows no such cut, a text is one piece.)

A task packs its documents into blocks: results of each document, and its id pairs as numbers into the
block's distinct pairs.  How many documents of the whole table hold a pair is a sum over the blocks' pairs;
the sums are joined back to the blocks and not to every link.

Defined results: a null or empty text, and one whose tokens on either side don't spell the text with a
space before it, has no tokens; each row is a document, repeated rows and null keys too; special tokens are
plain text; an empty table gives no rows.  Columns other than the key and the text aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lucidex.llm.bpe import byte_alphabet, default_tokenizer
from lucidex.llm.common import release, saved

#: Bytes of text that are aligned at a time, and after which a block is closed.
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20

#: A text is encoded in pieces of about this many characters, cut where no token of either side can cross.
PIECE_CHARS = 1 << 18

#: Where a text is split: a space between two characters that are no white space.
BETWEEN_WORDS = r"(?U)(?<=\S) (?=\S)"

#: Links of a run of texts that are worked on at a time.
RUN_LINKS = 1 << 20

#: Links that are put in one batch.
BATCH_LINKS = 1 << 20

BLOCK = "block long, docs binary, numbers binary, times binary, pair_a array<int>, pair_b array<int>, held array<long>"
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_shared long, n_best long, count_sum long, groups_sha256 string"
LINK = "a_at long, b_at long, a_id int, b_id int, bytes long"


# Sparse matrices.

@dataclass
class Csr:
    """A matrix in compressed rows: where each row starts, and the column and value of each entry."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.starts))

    def part(self, first: int, last: int) -> Csr:
        """Rows from first up to last."""
        a, b = self.starts[first], self.starts[last]
        return Csr(self.starts[first:last + 1] - a, self.columns[a:b], self.values[a:b])


def ones(starts: np.ndarray, columns: np.ndarray) -> Csr:
    return Csr(starts, columns, np.ones(len(columns), np.int64))


def product(x: Csr, y: Csr, width: int) -> Csr:
    """x·y, where y has *width* columns: for each entry of x the row of y that it names, merged by row and column."""
    counts = np.diff(y.starts)[x.columns]
    upto = np.cumsum(counts)
    rows = np.repeat(x.row_of(), counts)
    # The place of each gathered entry: the start of its row of y, and how far it is in that row.
    place = np.arange(len(rows)) + np.repeat(y.starts[x.columns] - (upto - counts), counts)
    key = rows * width + y.columns[place]
    values = np.repeat(x.values, counts) * y.values[place]
    if np.any(key[1:] < key[:-1]):
        order = np.argsort(key, kind="stable")
        key, values = key[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    merged = np.add.reduceat(values, first) if len(first) else values
    rows, columns = np.divmod(key[first], width)
    return Csr(np.searchsorted(rows, np.arange(x.rows + 1)), columns, merged)


# Tokenizers.

@dataclass
class Side:
    """A tokenizer: texts to ids, and the bytes of each id."""

    encode: object
    spelled: pa.Array

    @property
    def size(self) -> int:
        return len(self.spelled)


def _spelled(table: dict[int, bytes]) -> pa.Array:
    return pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.binary())


@functools.cache
def byte_level(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True  # their strings in a text are text
    model.no_padding()
    model.no_truncation()
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    bytes_of = byte_alphabet()
    table = {t["id"]: t["content"].encode() for t in told["added_tokens"]}
    table |= {i: bytes(bytes_of[c] for c in piece) for piece, i in told["model"]["vocab"].items() if all(c in bytes_of for c in piece)}
    return Side(lambda texts: [found.ids for found in model.encode_batch(texts, add_special_tokens=False)], _spelled(table))


@functools.cache
def pieces_of(path: str) -> Side:
    """A sentencepiece model; it adds a space before each text itself, so texts come with theirs taken off."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def spell(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Side(lambda texts: model.encode([text[1:] for text in texts], num_threads=1), _spelled({i: spell(i) for i in range(model.get_piece_size())}))


@functools.cache
def can_cut(path: str, pieces: str) -> bool:
    """If no token of either side goes on past a space that follows a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    with open(path, encoding="utf-8") as file:
        split = json.load(file).get("pre_tokenizer") or {}
    inside = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    return split.get("type") == "ByteLevel" and split.get("use_regex", True) and not inside


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_BETWEEN_WORDS = re.compile(r"(?<=\w) (?=\w)")


def cut(text: str, limit: int) -> list[str]:
    """The text in pieces of *limit* characters or little more; each but the first starts with a space between words."""
    parts, start = [], 0
    while len(text) - start > limit and (found := _BETWEEN_WORDS.search(text, start + limit)):
        parts.append(text[start:found.start()])
        start = found.start()
    return parts + [text[start:]]


def _ids(side: Side, cuts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each text has."""
    found = side.encode([part for parts in cuts for part in parts])
    sizes = np.array([len(one) for one in found], np.int64)
    of_text = np.repeat(np.arange(len(cuts)), [len(parts) for parts in cuts])
    return np.fromiter((i for one in found for i in one), np.int64, int(sizes.sum())), np.bincount(of_text, sizes, len(cuts)).astype(np.int64)


# Alignment of a slice of texts.

@dataclass
class Slice:
    """Aligned texts: token ids, tokens per text, byte ends, groups, and the links as a matrix A by B."""

    ids: tuple[np.ndarray, np.ndarray]
    sizes: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    groups: tuple[np.ndarray, np.ndarray]
    n_groups: int
    links: Csr

    def group_matrices(self) -> tuple[Csr, Csr]:
        """Tokens of A by groups, and groups by tokens of B."""
        a, b = self.groups
        return (ones(np.arange(len(a) + 1), a),
                ones(np.searchsorted(b, np.arange(self.n_groups + 1)), np.arange(len(b))))


def _spell(side: Side, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    taken = side.spelled.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4).astype(np.int64) if len(taken) else np.zeros(1, np.int64)
    return memoryview(taken.buffers()[2] or b""), ends


def align(texts: list[str | None], a: Side, b: Side, piece_chars: int | None) -> Slice:
    """Aligns texts with tokens on both sides; the others have no tokens."""
    whole = [" " + text if text else "" for text in texts]
    cuts = [([text] if piece_chars is None else cut(text, piece_chars)) if text else [] for text in whole]
    ids, sizes = zip(*(_ids(side, cuts) for side in (a, b)))
    spelled = [_spell(side, own) for side, own in zip((a, b), ids)]
    good = np.ones(len(texts), bool)
    upto = [np.concatenate([[0], np.cumsum(size)]) for size in sizes]
    for i, text in enumerate(whole):
        told = text.encode()
        good[i] = bool(told) and all(bytes(seen[ends[u[i]]:ends[u[i + 1]]]) == told for (seen, ends), u in zip(spelled, upto))
    ids = tuple(own[np.repeat(good, size)] for own, size in zip(ids, sizes))
    sizes = tuple(np.where(good, size, 0) for size in sizes)
    lengths = [np.diff(_spell(side, own)[1]) for side, own in zip((a, b), ids)]
    ends = tuple(np.cumsum(length) for length in lengths)
    cuts_at = np.intersect1d(*ends, assume_unique=True)
    groups = tuple(np.searchsorted(cuts_at, end) for end in ends)
    n_bytes = int(ends[0][-1]) if len(ends[0]) else 0
    by_byte = ones(np.concatenate([[0], ends[0]]), np.arange(n_bytes))
    to_token = ones(np.arange(n_bytes + 1), np.repeat(np.arange(len(ids[1])), lengths[1]))
    return Slice(ids, sizes, ends, groups, len(cuts_at), product(by_byte, to_token, max(len(ids[1]), 1)))


@functools.cache
def _numerals(size_a: int, size_b: int) -> pa.Array:
    """Ids as decimals with what follows them: of A a comma or a bar, of B a comma or a semicolon."""
    return pa.array([f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for i in range(size) for mark in marks])


def _group_texts(found: Slice, size_a: int, size_b: int) -> pa.Array:
    """Each text's groups, written as ``a1,a2|b1;a3|b2,b3;``."""
    (ids_a, ids_b), (groups_a, groups_b) = found.ids, found.groups
    last = [np.concatenate([g[1:] != g[:-1], [True]]) if len(g) else np.zeros(0, bool) for g in found.groups]
    before = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=found.n_groups))]) for g in found.groups]
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + before[1][groups_a]] = 2 * ids_a + last[0]
    order[np.arange(len(ids_b)) + before[0][groups_b + 1]] = 2 * size_a + 2 * ids_b + last[1]
    text = _numerals(size_a, size_b).take(pa.array(order))
    ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4) if len(text) else np.zeros(1, np.int32)
    upto = np.concatenate([[0], np.cumsum(found.sizes[0] + found.sizes[1])])
    return pa.StringArray.from_buffers(len(upto) - 1, pa.py_buffer(np.ascontiguousarray(ends[upto])), text.buffers()[2] if len(text) else pa.py_buffer(b""))


def _per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of values over texts with so many values each."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(sizes)])])


@dataclass
class Pieces:
    """Distinct pieces: if tokens on both sides spell them, counts, groups as text, and the id pair of each link."""

    good: np.ndarray
    counts: list[np.ndarray]
    groups: pa.Array
    pairs: pa.ListArray

    @classmethod
    def of(cls, pieces: pa.Array, a: Side, b: Side) -> Pieces:
        lengths = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [cls._of_slice(pieces.slice(first, size).to_pylist(), a, b) for first, size in _runs(lengths, SLICE_BYTES)]
        if not parts:
            return cls._of_slice([], a, b)
        return cls(np.concatenate([p.good for p in parts]), [np.concatenate(c) for c in zip(*(p.counts for p in parts))],
                   pa.concat_arrays([p.groups for p in parts]), pa.concat_arrays([p.pairs for p in parts]))

    @classmethod
    def _of_slice(cls, pieces: list[str], a: Side, b: Side) -> Pieces:
        found = align(pieces, a, b, None)
        per_token = np.diff(found.links.starts)
        in_group, per_group = found.group_matrices()
        shared = product(in_group, Csr(np.arange(found.n_groups + 1), np.zeros(found.n_groups, np.int64), np.diff(per_group.starts)), 1)
        ends = np.concatenate([found.groups[0][1:] != found.groups[0][:-1], [True]]) if len(found.ids[0]) else np.zeros(0, bool)
        n_links = _per_text(per_token, found.sizes[0])
        counts = [found.sizes[0], found.sizes[1], _per_text(ends.astype(np.int64), found.sizes[0]), n_links, _per_text(shared.values, found.sizes[0])]
        pair = found.ids[0][found.links.row_of()] * b.size + found.ids[1][found.links.columns]
        starts = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
        return cls(found.sizes[0] > 0, counts, _group_texts(found, a.size, b.size), pa.ListArray.from_arrays(pa.array(starts), pa.array(pair, pa.int64())))


def _runs(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts rows with such lengths into runs of about *limit*: first row and number of rows."""
    upto, first = np.cumsum(lengths, dtype=np.int64), 0
    while first < len(lengths):
        last = max(int(np.searchsorted(upto, upto[first] - lengths[first] + limit, "right")), first + 1)
        yield first, last - first
        first = last


def _measure(lists: pa.ListArray, a: Side, b: Side) -> Iterator[tuple[int, list[np.ndarray], list[str], np.ndarray, np.ndarray]]:
    """Texts as lists of pieces, in runs: the number of texts, their counts and digests, and their id pairs with how often each is linked.

    Pairs come text by text and ascend in each; the last of the counts is how many a text has.
    """
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    table, codes = Pieces.of(coded.dictionary, a, b), coded.indices.to_numpy(zero_copy_only=False)
    offsets, space = offsets - offsets[0], a.size * b.size
    links = np.concatenate([[0], np.cumsum(table.counts[3][codes])])[offsets] if len(codes) else offsets
    for first, size in _runs(np.diff(links), RUN_LINKS):
        upto = offsets[first:first + size + 1]
        own = codes[upto[0]:upto[-1]]
        sizes = np.diff(upto)
        bad = _per_text((~table.good[own]).astype(np.int64), sizes) > 0
        own = own[np.repeat(~bad, sizes)]
        sizes = np.where(bad, 0, sizes)
        counts = [_per_text(c[own], sizes) for c in table.counts]
        written = table.groups.take(pa.array(own))
        digests = [""] * size
        if len(written):
            ends = np.frombuffer(written.buffers()[1], np.int32, len(written) + 1, written.offset * 4)
            text, at = memoryview(written.buffers()[2]), np.concatenate([[0], np.cumsum(sizes)])
            digests = [hashlib.sha256(text[ends[x]:ends[y] - 1]).hexdigest() if x < y else "" for x, y in zip(at[:-1], at[1:])]
        taken = table.pairs.take(pa.array(own)).flatten().to_numpy()
        both, times = np.unique(np.repeat(np.arange(size), counts[3]) * space + taken, return_counts=True)
        yield size, counts + [np.bincount(both // space, minlength=size)], digests, both % space, times


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers byte by byte of equal weight, compressed: the high ones are mostly zero."""
    return pa.compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unplaned(packed: bytes, size: int) -> np.ndarray:
    if not size:
        return np.zeros(0, np.int32)
    raw = np.frombuffer(pa.decompress(packed, 4 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


def _close(keys: list[pa.Table], pairs: list[np.ndarray], times: list[np.ndarray], name: int, size_b: int) -> pa.RecordBatch:
    docs = pa.concat_tables(keys)
    own, number = np.unique(np.concatenate(pairs), return_inverse=True)
    held = np.bincount(number, minlength=len(own))
    # A text's numbers ascend, so steps between them are small; its first one is told from 0.
    starts = np.cumsum(docs.column("n_pairs").to_numpy())[:-1]
    steps = np.diff(number, prepend=0)
    starts = starts[starts < len(steps)]
    steps[starts] = number[starts]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(docs)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    return pa.RecordBatch.from_arrays([
        pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([_planes(steps)], pa.binary()),
        pa.array([_planes(np.concatenate(times))], pa.binary()), one(own // size_b, pa.int32()), one(own % size_b, pa.int32()), one(held, pa.int64())],
        ["block", "docs", "numbers", "times", "pair_a", "pair_b", "held"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about SLICE_BYTES of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    for first, size in _runs(lengths, SLICE_BYTES):
        yield batch.slice(first, size)


def blocks_of(docs: DataFrame, key: str, tokenizer: str, pieces: str, split: bool, block_bytes: int) -> DataFrame:
    """Aligned documents packed into blocks.  Names of blocks hold only for this execution: save the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(tokenizer), pieces_of(pieces)
        task = TaskContext.get()
        prefix, made = (task.partitionId() if task else 0) << 24, 0
        keys, pairs, times, held = [], [], [], 0
        for batch in batches:
            at = 0
            for size, counts, digests, pair, often in _measure(batch.column("pieces"), a, b):
                keys.append(pa.Table.from_arrays(
                    [batch.column(key).take(pa.array(np.arange(at, at + size)))] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string())],
                    ["key", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_pairs", "groups_sha256"]))
                pairs.append(pair)
                times.append(often.astype(np.int32))
                at += size
            held += batch.column("pieces").nbytes
            if held >= block_bytes:
                yield _close(keys, pairs, times, prefix + made, b.size)
                keys, pairs, times, held, made = [], [], [], 0, made + 1
        if keys:
            yield _close(keys, pairs, times, prefix + made, b.size)

    cut_up = F.split("text", BETWEEN_WORDS) if split else F.array("text")
    whole = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, cut_up).otherwise(F.array().cast("array<string>"))
    return docs.select(F.col(key), whole.alias("pieces")).mapInArrow(run, BLOCK)


def _finish(key: str, schema: pa.Schema):
    def run(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(pairs.column("number").to_numpy(), kind="stable") if pairs.num_rows else np.zeros(0, np.int64)
        counts = pairs.column("count").to_numpy()[order] if pairs.num_rows else order
        best = pairs.column("best").to_numpy()[order] if pairs.num_rows else order.astype(bool)
        for docs, numbers, times in zip(*(blocks.column(c) for c in ("docs", "numbers", "times"))):
            told = pa.ipc.open_stream(docs.as_py()).read_all()
            sizes = told.column("n_pairs").to_numpy()
            total = int(sizes.sum())
            often = _unplaned(times.as_py(), total).astype(np.int64)
            number = np.cumsum(_unplaned(numbers.as_py(), total), dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            if total:
                number -= np.repeat(np.where(starts > 0, number[np.maximum(starts, 1) - 1], 0), sizes)
            summed = [_per_text(often * best[number], sizes), _per_text(often * counts[number], sizes)]
            out.append(pa.Table.from_arrays(
                [told.column(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links", "n_shared")]
                + [pa.array(s, pa.int64()) for s in summed] + [told.column("groups_sha256")], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def aligned(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, key: str = "doc_id",
            split: bool = True, block_bytes: int | None = None) -> DataFrame:
    """Per document the key, token, group and link counts, n_best, count_sum and groups_sha256.

    n_shared is the number of pairs of tokens that share a group.  Without *split*, or where the tokenizers
    don't allow it, texts are encoded as wholes, with the same results.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    tokenizer, pieces = tokenizer or default_tokenizer(), pieces or default_pieces()
    blocks = saved(blocks_of(docs, key, tokenizer, pieces, split and can_cut(tokenizer, pieces), block_bytes or BLOCK_BYTES), "aligned-blocks")
    own = blocks.select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "held")).alias("number", "p")).select(
        "block", "number", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.held").alias("held"))
    counts = saved(own.groupBy("a", "b").agg(F.sum("held").alias("count")), "aligned-counts")
    # One row for each id of the first vocabulary at most.
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    rated = counts.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    back = saved(own.join(rated, ["a", "b"]).select("block", "number", "count", "best"), "aligned-back")
    release(counts)
    kind = docs.schema[key].dataType.simpleString()
    spec = f"`{key}` {kind}, {RESULT}"
    return (blocks.select("block", "docs", "numbers", "times").groupBy("block").cogroup(back.groupBy("block"))
            .applyInArrow(_finish(key, to_arrow_schema(StructType.fromDDL(spec))), spec))


def links(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, key: str = "doc_id", shared: bool = False) -> DataFrame:
    """One row per link: the key, places and ids of both tokens, and the bytes they share.

    *shared* gives the pairs of tokens in one group instead (with 0 bytes where they share none); a group
    of many tokens on both sides has the product of these.
    """
    tokenizer, pieces = tokenizer or default_tokenizer(), pieces or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(tokenizer), pieces_of(pieces)
        limit = PIECE_CHARS if can_cut(tokenizer, pieces) else None
        for batch in batches:
            for rows in _slices(batch):
                found = align(rows.column("text").to_pylist(), a, b, limit)
                of_a = np.repeat(np.arange(rows.num_rows), found.sizes[0])
                before = [np.concatenate([[0], np.cumsum(s)]) for s in found.sizes]
                first, width = 0, max(len(found.ids[1]), 1)
                left, right = found.group_matrices()
                row_links = np.diff(right.starts)[found.groups[0]] if shared else np.diff(found.links.starts)
                upto = np.cumsum(row_links)
                while first < len(of_a):
                    done = upto[first] - row_links[first]
                    last = max(int(np.searchsorted(upto, done + BATCH_LINKS, "right")), first + 1)
                    part = found.links.part(first, last)
                    if shared:
                        pairs = product(left.part(first, last), right, width)
                        overlap = values_at(pairs, part, width)
                    else:
                        pairs, overlap = part, part.values
                    at = first + pairs.row_of()
                    text = of_a[at]
                    yield pa.RecordBatch.from_arrays([
                        rows.column(key).take(pa.array(text)), pa.array(at - before[0][text]), pa.array(pairs.columns - before[1][text]),
                        pa.array(found.ids[0][at], pa.int32()), pa.array(found.ids[1][pairs.columns], pa.int32()), pa.array(overlap, pa.int64())],
                        [key, "a_at", "b_at", "a_id", "b_id", "bytes"])
                    first = last

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), "text").mapInArrow(run, f"`{key}` {kind}, {LINK}")


def values_at(wanted: Csr, known: Csr, width: int) -> np.ndarray:
    """The values that *known* has at the entries of *wanted*, 0 where it has none."""
    keys, asked = known.row_of() * width + known.columns, wanted.row_of() * width + wanted.columns
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, known.values[at], 0)

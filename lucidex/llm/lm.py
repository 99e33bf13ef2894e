"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

The model is folders of sorted arrays: word hashes in pieces by their top bits (a word's number is its
place in that order), figures per word in the same order, and pair hashes with counts in pieces by
their top bits.  A pair's hash is a one-to-one mixing of the two word numbers, so pairs never clash.
Pieces are written by the tasks that counted them; scoring opens them with ``mmap`` and looks up the
distinct words and pairs of a block of texts.
"""

from __future__ import annotations

import io
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from lucidex.llm.blocks import Block, read_block, token_blocks
from lucidex.llm.common import ascii_lower, saved, whole_text, words_of, work_path

#: The end of a text as a word; no word has a space.
END = " end"

#: About how many words or pairs a piece of the model holds (a task sorts a piece's pairs of all blocks at once),
#: and how many tokens are scored at a time.
PIECE_WORDS = 1 << 20
PIECE_PAIRS = 1 << 20
SLICE_TOKENS = 1 << 19

#: Bytes of words in a block: all of a block's pairs are sorted at once.
BLOCK_BYTES = 24 << 20

#: Numbers of words in a pair have 32 bits, of which one value is the start of a text.
MOST_WORDS = (1 << 32) - 1

_U = np.uint64


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """A piece of the model; a repeated task writes the same piece again."""
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    buffer = io.BytesIO()
    np.save(buffer, values)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(buffer.getbuffer())
    system.move(draft, f"{path}/{name}.npy")


_copies: dict[str, str] = {}


def open_array(folder: str, name: str) -> np.ndarray:
    """A piece as a memory map; from a store without files a worker keeps a copy on its disk."""
    system, path = _filesystem(folder)
    place = f"{path}/{name}.npy"
    if not isinstance(system, fs.LocalFileSystem):
        local = _copies.setdefault(folder, tempfile.mkdtemp(prefix="lucidex-model-"))
        own = f"{local}/{name}.npy"
        if not os.path.exists(own):
            with system.open_input_stream(place) as source, open(f"{own}.part", "wb") as target:
                shutil.copyfileobj(source, target)
            os.replace(f"{own}.part", own)
        place = own
    return np.load(place, mmap_mode="r")


def mix(numbers: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = numbers.astype(_U, copy=True)
    for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9), (32, 1)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    return x


def unmix(numbers: np.ndarray) -> np.ndarray:
    x = numbers.astype(_U, copy=True)
    for shift, factor in ((32, 1), (29, 0xBF58476D1CE4E5B9), (32, 0x9E3779B97F4A7C15)):
        x *= _U(pow(factor, -1, 1 << 64))
        x ^= (x >> _U(shift)) ^ ((x >> _U(2 * shift)) if 2 * shift < 64 else _U(0))
    return x


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _bits(rows: int, piece: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / piece)))


def discounts(n: list[int]) -> list[float]:
    """What modified Kneser-Ney takes from counts of 1, 2 and 3 or more, given n1 to n4."""
    if not all(n[:3]):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)]


@dataclass(frozen=True)
class Model:
    folder: str
    word_bits: int
    pair_bits: int
    #: First number of each piece of words, and their total at the end.
    starts: tuple[int, ...]
    documents: int
    tokens: int
    words: int
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    pair_kinds: int
    #: Discounted mass of the continuation counts.
    spare: float

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word hash, -1 where the model doesn't know it."""
        out = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        wanted = hashes[order]
        cuts = np.searchsorted(_top(wanted, self.word_bits), np.arange((1 << self.word_bits) + 1))
        for piece in range(1 << self.word_bits):
            own = wanted[cuts[piece]:cuts[piece + 1]]
            if len(own) and self.starts[piece + 1] > self.starts[piece]:
                known = open_array(self.folder, f"words-{piece}")
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                out[order[cuts[piece]:cuts[piece + 1]]] = np.where(known[at] == own, self.starts[piece] + at, -1)
        return out

    def figures(self, numbers: np.ndarray) -> np.ndarray:
        """Per word number a row: count, pairs that end in it, total, n1, n2 and n3 of pairs that begin with it."""
        out = np.zeros((len(numbers), 6), np.int64)
        for piece in range(1 << self.word_bits):
            own = (numbers >= self.starts[piece]) & (numbers < self.starts[piece + 1])
            if own.any():
                out[own] = open_array(self.folder, f"figures-{piece}")[numbers[own] - self.starts[piece]]
        return out

    def pair_counts(self, mixed: np.ndarray) -> np.ndarray:
        """Counts of sorted pair hashes."""
        out = np.zeros(len(mixed), np.int64)
        cuts = np.searchsorted(_top(mixed, self.pair_bits), np.arange((1 << self.pair_bits) + 1))
        for piece in range(1 << self.pair_bits):
            own = mixed[cuts[piece]:cuts[piece + 1]]
            if len(own):
                known = open_array(self.folder, f"pairs-{piece}")
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    counts = open_array(self.folder, f"counts-{piece}")
                    out[cuts[piece]:cuts[piece + 1]] = np.where(known[at] == own, counts[at], 0)
        return out


def _sequence(block: Block, number_of: np.ndarray, end: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers with an end after each text, the number before each (start: -2), and where texts begin."""
    offsets = block.offsets[first:last + 1]
    own = number_of[block.numbers[offsets[0]:offsets[-1]]]
    lengths = np.diff(offsets) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    now = np.full(starts[-1], end, np.int64)
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    now[inside] = own
    before = np.concatenate([[-2], now[:-1]])
    before[starts[:-1]] = -2
    return now, before, starts


def _slices(block: Block) -> Iterator[tuple[int, int]]:
    first, total = 0, len(block.offsets) - 1
    while first < total:
        last = int(np.searchsorted(block.offsets, block.offsets[first] + SLICE_TOKENS, "right")) - 1
        last = min(max(last, first + 1), total)
        yield first, last
        first = last


def _keys(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """One number for a pair; the start of a text is number 0 and words follow."""
    return mix(((np.maximum(before, -1) + 1).astype(_U) << _U(32)) | (now + 1).astype(_U))


def _pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    wide = values.dtype.itemsize
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, wide).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, size: int, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    planes = pa.decompress(packed, size * wide, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(wide, size).T).view(kind).ravel()


def _hashes(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column("hashes")[i].values.to_numpy(zero_copy_only=False).view(_U)


def _train_docs(block: Block) -> np.ndarray:
    return ~np.asarray(block.keys.column("held_out").to_numpy(zero_copy_only=False), bool)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = read_block(batch.column("docs")[i].as_py(), batch.column("numbers")[i].as_py())
            train = _train_docs(block)
            inside = np.repeat(train, np.diff(block.offsets))
            words = batch.column("words")[i].values
            counts = np.bincount(block.numbers[inside], minlength=len(words))
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.take(pa.array(seen)), pa.array([END])]),
                 pa.array(np.concatenate([counts[seen], [train.sum()]]).astype(np.int64))], ["word", "n"])


def train(blocks: DataFrame) -> Model:
    """Counts the training texts of the blocks (key ``held_out`` false) into a model.

    Words are counted by groupBy; pairs by block first, then by piece of their hash.  The driver gets
    one row per piece of the model.  No training text: a model that knows no word.
    """
    folder = work_path(blocks.sparkSession, "lm-model")
    vocabulary = saved(blocks.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
                       .filter("n > 0").select(F.xxhash64("word").alias("hash"), "n", (F.col("word") == END).alias("is_end")), "lm-words")
    found = vocabulary.agg(F.count(F.lit(1)).alias("words"), F.countDistinct("hash").alias("kinds"), F.sum("n").alias("tokens"),
                           F.sum(F.when(F.col("is_end"), F.col("n"))).alias("documents")).first()
    if found["words"] != found["kinds"]:
        raise ValueError("two words of the corpus share a 64-bit hash")
    if found["words"] >= MOST_WORDS:
        raise ValueError(f"a pair holds two word numbers of 32 bits; the corpus has {found['words']} distinct words")
    word_bits = _bits(found["words"], PIECE_WORDS)

    def keep_words(group: pa.Table) -> pa.Table:
        hashes = group.column("hash").to_numpy().view(_U)
        order = np.argsort(hashes)
        piece = group.column("piece")[0].as_py()
        write_array(folder, f"words-{piece}", hashes[order])
        write_array(folder, f"n-{piece}", group.column("n").to_numpy()[order])
        return pa.table({"piece": pa.array([piece], pa.int32()), "size": pa.array([len(hashes)], pa.int64())})

    top = F.shiftrightunsigned("hash", 64 - word_bits).cast("int") if word_bits else F.lit(0)
    sizes = dict(vocabulary.withColumn("piece", top).groupBy("piece").applyInArrow(keep_words, "piece int, size long").collect())
    starts = tuple(np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(1 << word_bits)])]).tolist())
    tokens, documents = found["tokens"] or 0, found["documents"] or 0
    # Pairs are at most as many as tokens; about half of them differ.
    pair_bits = _bits(tokens // 2, PIECE_PAIRS)
    half = Model(folder, word_bits, pair_bits, starts, documents, tokens, found["words"], (), (), 0, 0.0)
    end_hash = blocks.sparkSession.range(1).select(F.xxhash64(F.lit(END))).first()[0]

    def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(half.numbers(np.array([end_hash]).view(_U))[0])
        for batch in batches:
            for i in range(batch.num_rows):
                block = read_block(batch.column("docs")[i].as_py(), batch.column("numbers")[i].as_py())
                number_of = half.numbers(_hashes(batch, i))
                is_train = _train_docs(block)
                keys = []
                for first, last in _slices(block):
                    now, before, begins = _sequence(block, number_of, end, first, last)
                    inside = np.repeat(is_train[first:last], np.diff(begins))
                    keys.append(_keys(before[inside], now[inside]))
                mixed, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, _U), return_counts=True)
                cuts = np.searchsorted(_top(mixed, pair_bits), np.arange((1 << pair_bits) + 1))
                pieces = [p for p in range(1 << pair_bits) if cuts[p + 1] > cuts[p]]
                part = lambda v, p: v[cuts[p]:cuts[p + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(pieces, pa.int32()), pa.array([len(part(mixed, p)) for p in pieces], pa.int64()),
                    pa.array([_pack(np.diff(part(mixed, p), prepend=_U(0))) for p in pieces], pa.binary()),
                    pa.array([_pack(part(counts, p)) for p in pieces], pa.binary())], ["piece", "size", "keys", "counts"])

    def keep_pairs(group: pa.Table) -> pa.Table:
        """Writes a piece; returns its figures by piece of words: (piece, what, numbers, values)."""
        sizes_, packed = group.column("size").to_pylist(), group.column("keys")
        mixed = np.concatenate([np.cumsum(_unpack(k.as_py(), n, _U), dtype=_U) for k, n in zip(packed, sizes_)])
        counts = np.concatenate([_unpack(c.as_py(), n, np.int64) for c, n in zip(group.column("counts"), sizes_)])
        del packed
        order = np.argsort(mixed, kind="stable")
        mixed, counts = mixed[order], counts[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
        mixed, counts = mixed[first], np.add.reduceat(counts, first)
        del first
        piece = group.column("piece")[0].as_py()
        write_array(folder, f"pairs-{piece}", mixed)
        write_array(folder, f"counts-{piece}", counts)
        plain = unmix(mixed)
        del mixed
        before, now = (plain >> _U(32)).astype(np.int64) - 1, (plain & _U(0xFFFFFFFF)).astype(np.int64) - 1
        del plain
        rows = {"piece": [], "ending": [], "size": [], "numbers": [], "values": []}
        for numbers, values, ending in ((now, [np.ones(len(now), np.int64)], True),
                                        (before, [counts, counts == 1, counts == 2, counts >= 3], False)):
            kinds, at = np.unique(numbers, return_inverse=True)
            # Sums in order of the number; whole numbers throughout, as floats would round great ones.
            order = np.argsort(at, kind="stable")
            begins = np.searchsorted(at[order], np.arange(len(kinds)))
            sums = np.stack([np.add.reduceat(v[order].astype(np.int64), begins) for v in values])
            del order, at
            cuts = np.searchsorted(kinds, starts)
            if not ending and len(kinds) and kinds[0] == -1:  # the start of a text, which is no word
                rows["piece"].append(-1)
                rows["ending"].append(False)
                rows["size"].append(1)
                rows["numbers"].append(_pack(np.zeros(1, np.uint32)))
                rows["values"].append(_pack(np.ascontiguousarray(sums[:, :1])))
            for p in range(1 << word_bits):
                if cuts[p + 1] > cuts[p]:
                    own = slice(cuts[p], cuts[p + 1])
                    rows["piece"].append(p)
                    rows["ending"].append(ending)
                    rows["size"].append(cuts[p + 1] - cuts[p])
                    rows["numbers"].append(_pack((kinds[own] - starts[p]).astype(np.uint32)))
                    rows["values"].append(_pack(np.ascontiguousarray(sums[:, own])))
        seen = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(counts)]
        rows["piece"].append(-2)
        rows["ending"].append(False)
        rows["size"].append(0)
        rows["numbers"].append(b"")
        rows["values"].append(np.array(seen, np.int64).tobytes())
        return pa.table(rows, schema=pa.schema([("piece", pa.int32()), ("ending", pa.bool_()), ("size", pa.int64()),
                                                ("numbers", pa.binary()), ("values", pa.binary())]))

    figures = saved(blocks.mapInArrow(block_pairs, "piece int, size long, keys binary, counts binary").groupBy("piece")
                    .applyInArrow(keep_pairs, "piece int, ending boolean, size long, numbers binary, values binary"), "lm-figures")

    def keep_figures(group: pa.Table) -> pa.Table:
        piece = group.column("piece")[0].as_py()
        table = np.zeros((1 if piece < 0 else starts[piece + 1] - starts[piece], 6), np.int64)
        if piece >= 0:
            table[:, 0] = open_array(folder, f"n-{piece}")
        for ending, size, numbers, values in zip(*(group.column(c).to_pylist() for c in ("ending", "size", "numbers", "values"))):
            at = _unpack(numbers, size, np.uint32)
            told = _unpack(values, size * (1 if ending else 4), np.int64).reshape(-1, size)
            if ending:
                table[at, 1] += told[0]
            else:
                table[at, 2:6] += told.T
        write_array(folder, "figures-start" if piece < 0 else f"figures-{piece}", table)
        kinds = [int((table[:, 1] == k).sum()) for k in (1, 2, 3, 4)] + [int((table[:, 1] >= 3).sum())]
        return pa.table({"piece": pa.array([piece], pa.int32()), "kinds": pa.array([kinds], pa.list_(pa.int64()))})

    kept = figures.filter("piece > -2").groupBy("piece").applyInArrow(keep_figures, "piece int, kinds array<long>").collect()
    seen = np.sum([np.frombuffer(r["values"], np.int64) for r in figures.filter("piece = -2").select("values").collect()] or [np.zeros(5, np.int64)], axis=0)
    kinds = np.sum([r["kinds"] for r in kept] or [np.zeros(5, np.int64)], axis=0)
    word_discounts = discounts([int(k) for k in kinds[:4]])
    spare = word_discounts[0] * kinds[0] + word_discounts[1] * kinds[1] + word_discounts[2] * kinds[4]
    return Model(folder, word_bits, pair_bits, starts, documents, tokens, found["words"], tuple(discounts([int(n) for n in seen[:4]])),
                 tuple(word_discounts), int(seen[4]), float(spare))


def score(blocks: DataFrame, model: Model, keys: dict[str, str]) -> DataFrame:
    """Per text its keys, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    ``score`` is the log10 probability under the model, its end included.  A word that the model does
    not know gets an equal share of the lowest mass; after an unknown word the word alone decides.
    """
    end_hash = blocks.sparkSession.range(1).select(F.xxhash64(F.lit(END))).first()[0]
    spec = ", ".join([f"`{k}` {t}" for k, t in keys.items()] + ["n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double", "perplexity double"])

    def taken(counts: np.ndarray, by: tuple[float, ...]) -> np.ndarray:
        return np.array([0.0, *by])[np.minimum(counts, 3)]

    def word_shares(figures: np.ndarray) -> np.ndarray:
        flat = 1.0 / (model.words + 1)
        if not model.pair_kinds:
            return np.full(len(figures), flat)
        ends = figures[:, 1]
        return (ends - taken(ends, model.word_discounts)) / model.pair_kinds + model.spare / model.pair_kinds * flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(model.numbers(np.array([end_hash]).view(_U))[0])
        for batch in batches:
            for i in range(batch.num_rows):
                block = read_block(batch.column("docs")[i].as_py(), batch.column("numbers")[i].as_py())
                # Local numbers for the block: its distinct words, then the end, then the start.
                number_of = np.concatenate([model.numbers(_hashes(batch, i)), [end]])
                figures = model.figures(number_of)
                begin = open_array(model.folder, "figures-start")[:1] if model.pair_kinds else np.zeros((1, 6), np.int64)
                figures = np.concatenate([figures, begin])
                shares = word_shares(figures)
                left = figures[:, 3:6] @ np.array(model.pair_discounts)
                size = len(number_of) - 1
                base = np.log10((figures[:, 0] + 1) / (model.tokens + (model.words + 1)))
                out = [[], [], [], []]
                for first, last in _slices(block):
                    now, before, begins = _sequence(block, np.arange(size), size, first, last)
                    before = np.where(before == -2, size + 1, before)
                    total = figures[before, 2]
                    known = (number_of[now] >= 0) & (total > 0)
                    counts = np.zeros(len(now), np.int64)
                    real = np.where(before[known] > size, -1, number_of[np.minimum(before[known], size)])
                    mixed, at = np.unique(_keys(real, number_of[now[known]]), return_inverse=True)
                    counts[known] = model.pair_counts(mixed)[at]
                    safe = np.maximum(total, 1)
                    chance = np.where(total > 0, (counts - taken(counts, model.pair_discounts)) / safe + left[before] / safe * shares[now], shares[now])
                    out[0].append(np.diff(begins))
                    out[1].append(np.add.reduceat((figures[now, 0] > 0).astype(np.int64), begins[:-1]))
                    out[2].append(np.add.reduceat(base[now], begins[:-1]))
                    out[3].append(np.add.reduceat(np.log10(chance), begins[:-1]))
                tokens, seen, plain, scores = (np.concatenate(x) for x in out)
                columns = [block.keys.column(k).combine_chunks() for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], pa.array(tokens.astype(np.int64)), pa.array(seen),
                     pa.array(np.full(len(tokens), model.tokens, np.int64)), pa.array(plain), pa.array(scores), pa.array(10 ** (-scores / tokens))],
                    [*keys, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return blocks.mapInArrow(run, spec)


def held_out(folds: int = 7, fold: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))


def train_and_score(docs: DataFrame) -> DataFrame:
    """Every whole text scored by a model of the texts that are not held out (A-Z lower-cased; null: empty).

    A row with a null doc_id is a training row; repeated rows count each time.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    blocks = saved(token_blocks(marked, ["doc_id", "held_out"], words_of(ascii_lower(whole_text())), BLOCK_BYTES), "lm-blocks").withColumn(
        "hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return score(blocks, train(blocks), {"doc_id": key, "held_out": "boolean"})

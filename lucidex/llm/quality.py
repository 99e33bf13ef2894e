"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages and only the document is labelled.  Each passage is encoded, gated
attention weighs the passages, and the weighted sum of their codes is scored; all parts are learned
together from the document labels.  Fitting sees a bounded sample, scoring every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lucidex.llm.common import whole_text

#: Words in a passage, and words looked at together.
PASSAGE_WORDS = 64
SLICE_WORDS = 1 << 18

#: Labelled documents that the model is fitted on, at most; chosen by a hash of the doc_id.
SAMPLE = 8000

HASHED = 12
CODE = 16
GATE = 12

_CLASSES = ("upper", "lower", "digit", "symbol", "mark", "other_ascii", "beyond_ascii")
FEATURES = len(_CLASSES) + 3 + HASHED + 3


def _byte_classes() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES)), np.float32)
    for b in range(256):
        c = chr(b)
        kind = (6 if b > 127 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit()
                else 3 if c in "#*$%&|<>" else 4 if c in "!?" else 5)
        table[b, kind] = 1
    return table


_BYTE_CLASSES = _byte_classes()


def _word_features(words: list[bytes]) -> np.ndarray:
    """Shares of kinds of bytes, length, first letter, and a few signs drawn by a hash, per word."""
    from zlib import crc32

    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    data = np.frombuffer(b"".join(words), np.uint8)
    counts = np.add.reduceat(_BYTE_CLASSES[data], starts, axis=0) if len(words) else np.zeros((0, len(_CLASSES)), np.float32)
    shares = counts / lengths[:, None]
    first_upper = _BYTE_CLASSES[data[starts], 0] if len(words) else np.zeros(0, np.float32)
    all_upper = (counts[:, 0] == counts[:, 0] + counts[:, 1]) & (counts[:, 0] > 1)
    hashes = np.fromiter((crc32(w.lower()) for w in words), np.uint32, len(words))
    signs = ((hashes[:, None] >> np.arange(HASHED, dtype=np.uint32)) & 1).astype(np.float32) * 2 - 1
    return np.concatenate([shares, np.log1p(lengths)[:, None], first_upper[:, None], all_upper[:, None], signs], axis=1).astype(np.float32)


def encode_passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The passages' features, text after text, and how many each text has (one, of zeros, without words)."""
    split = [t.encode().split() for t in texts]  # bytes split at ASCII white space only
    counts = np.array([len(w) for w in split], np.int64)
    passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    out = np.zeros((int(passages.sum()), FEATURES), np.float32)
    row, first = 0, 0
    while first < len(split):
        last, held = first, 0
        while last < len(split) and (last == first or held + counts[last] <= SLICE_WORDS):
            held += counts[last]
            last += 1
        words = [w for doc in split[first:last] for w in doc]
        own = passages[first:last]
        if words:
            coded = pa.array(words, pa.binary()).dictionary_encode()
            number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            table = _word_features(coded.dictionary.to_pylist())
            sizes = np.concatenate([np.full(p, PASSAGE_WORDS) for p in own])
            ends = np.cumsum(own) - 1
            sizes[ends] = counts[first:last] - (own - 1) * PASSAGE_WORDS
            full = np.flatnonzero(sizes)
            begins = (np.cumsum(sizes) - sizes)[full]
            n = sizes[full].astype(np.float32)
            means = np.empty((len(full), table.shape[1]), np.float32)
            for c in range(0, len(full), 2048):  # a few passages at a time
                stop = begins[c + 2048] if c + 2048 < len(full) else len(number)
                means[c:c + 2048] = np.add.reduceat(table[number[begins[c]:stop]], begins[c:c + 2048] - begins[c], axis=0)
            means /= n[:, None]
            of = np.repeat(np.arange(len(full)), sizes[full])
            distinct = np.bincount(np.unique(of * len(table) + number) // len(table), minlength=len(full)) / n
            same = np.concatenate([[False], (number[1:] == number[:-1]) & (of[1:] == of[:-1])])
            out[row + full] = np.concatenate([means, distinct[:, None], (np.bincount(of, same, len(full)) / n)[:, None], (n / PASSAGE_WORDS)[:, None]], axis=1)
        row += int(own.sum())
        first = last
    return out, passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Weights; see :meth:`forward` for what they do."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    @staticmethod
    def blank() -> AttentionModel:
        """Scores everything 0.5."""
        shapes = {"encode": (FEATURES, CODE), "encode0": (CODE,), "see": (CODE, GATE), "gate": (CODE, GATE), "weigh": (GATE,), "judge": (CODE,), "judge0": (1,)}
        return AttentionModel({k: np.zeros(s) for k, s in shapes.items()}, np.zeros(FEATURES), np.ones(FEATURES))

    def forward(self, features: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (features - self.mean) / self.scale
        code = np.tanh(x @ w["encode"] + w["encode0"])
        seen, gate = np.tanh(code @ w["see"]), _sigmoid(code @ w["gate"])
        logit = (seen * gate) @ w["weigh"]
        starts = np.cumsum(passages) - passages
        bag = np.repeat(np.arange(len(passages)), passages)
        grown = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
        attention = grown / np.add.reduceat(grown, starts)[bag]
        summed = np.add.reduceat(attention[:, None] * code, starts, axis=0)
        return {"x": x, "code": code, "seen": seen, "gate": gate, "attention": attention, "starts": starts, "bag": bag,
                "summed": summed, "score": _sigmoid(summed @ w["judge"] + w["judge0"])}

    def gradients(self, features: np.ndarray, passages: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        w, f = self.weights, self.forward(features, passages)
        error = (f["score"] - labels) / len(labels)
        d_summed = error[:, None] * w["judge"]
        towards = d_summed[f["bag"]]
        value = (towards * f["code"]).sum(1)
        mean_value = np.add.reduceat(f["attention"] * value, f["starts"])[f["bag"]]
        d_logit = f["attention"] * (value - mean_value)
        d_seen = d_logit[:, None] * w["weigh"] * f["gate"] * (1 - f["seen"] ** 2)
        d_gate = d_logit[:, None] * w["weigh"] * f["seen"] * f["gate"] * (1 - f["gate"])
        d_code = (f["attention"][:, None] * towards + d_seen @ w["see"].T + d_gate @ w["gate"].T) * (1 - f["code"] ** 2)
        return {"encode": f["x"].T @ d_code, "encode0": d_code.sum(0), "see": f["code"].T @ d_seen, "gate": f["code"].T @ d_gate,
                "weigh": (f["seen"] * f["gate"]).T @ d_logit, "judge": f["summed"].T @ error, "judge0": error.sum(keepdims=True)}


def fit(features: np.ndarray, passages: np.ndarray, labels: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.01,
        decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Fits the model by Adam; the same sample gives the same model."""
    model = AttentionModel.blank()
    if not len(labels):
        return model
    rng = np.random.default_rng(seed)
    model.mean, model.scale = features.mean(0), features.std(0) + 1e-3
    for name, value in model.weights.items():
        if value.ndim == 2 or name in ("weigh", "judge"):
            model.weights[name] = rng.normal(0, 1 / np.sqrt(len(value)), value.shape)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    starts = np.cumsum(passages) - passages
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            rows = np.concatenate([np.arange(starts[i], starts[i] + passages[i]) for i in own])
            found = model.gradients(features[rows], passages[own], labels[own])
            step += 1
            slow = rate * (1 - epoch / epochs)
            for k, g in found.items():
                g = g + decay * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - slow * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def held_out(folds: int = 3, fold: int = 1):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, passages = encode_passages(batch.column("text").to_pylist())
        cuts = np.concatenate([[0], np.cumsum(passages)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array([features[cuts[i]:cuts[i + 1]].tobytes() for i in range(len(passages))], pa.binary())],
            ["quality", "passages"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel:
    """A model from the labelled documents that are not held out, at most *sample* of them.

    The sample's passages come to the driver: at most *sample* documents' features, about a hundred
    bytes for each passage of 64 words.  Labels without a quality or a document play no part.
    """
    chosen = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out())
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id"))
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("quality", whole_text().alias("text"))
    rows = texts.mapInArrow(_encoded, "quality int, passages binary").collect()
    rows.sort(key=lambda r: (bytes(r["passages"]), r["quality"]))
    bags = [np.frombuffer(r["passages"], np.float32).reshape(-1, FEATURES) for r in rows]
    if not bags:
        return AttentionModel.blank()
    return fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([float(r["quality"] == 1) for r in rows]))


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, score (0 to 1), n_passages and focus (the passage of most weight, from 0) of every whole text."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, passages = encode_passages(batch.column("text").to_pylist())
            found = model.forward(features, passages)
            top = np.maximum.reduceat(found["attention"], found["starts"])
            best = np.flatnonzero(found["attention"] == top[found["bag"]])
            focus = best[np.searchsorted(best, found["starts"])] - found["starts"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found["score"]), pa.array(passages, pa.int64()), pa.array(focus, pa.int64())],
                ["doc_id", "score", "n_passages", "focus"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {key}, score double, n_passages long, focus long")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and focus of every document.

    A null or empty text is scored as one passage without words.  Without usable labels every score is
    0.5.  Repeated rows are scored each; a null doc_id is not held out.
    """
    scored = score(docs, train(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "focus")

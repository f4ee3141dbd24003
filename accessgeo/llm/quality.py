"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A word stands for itself if the sample has it often enough, and always for its shape (runs of upper
case, lower case and digits, other characters as they are). Each such key has a sparse random index vector; its word vector is its index vector plus those
of its neighbours over the sample. A document is the mean of its words' vectors and a few ratios.
The network's logits are divided by a temperature fitted on rows the weights have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import coded, plain_text, slices, word_lists
from .labelled import MAX_LABELLED, fitted, held_out

DIMENSIONS, NONZERO, VOCABULARY, SHAPES, LEAST, REACH = 48, 6, 8_000, 2_000, 5, 2
#: Neighbouring pairs that are summed at once.
PAIRS = 100_000
_SHAPE = [(re.compile(r"[^\W\d_a-z]*[A-ZÀ-Þ][^\W\d_a-z]*"), "X"), (re.compile(r"[^\W\d_A-Z]+"), "x"), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1")]


def shape(word: str) -> str:
    for pattern, new in _SHAPE:
        word = pattern.sub(new, word)
    return word[:12]


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse random vectors of NONZERO entries, half of them -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIMENSIONS), np.float32)
    at = np.argsort(rng.random((n, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, np.tile([1.0, -1.0], NONZERO // 2).astype(np.float32)[None, :].repeat(n, 0), 1)
    return out


class Keys:
    """Numbers of the keys: words first, then shapes; unknown ones share the last number of their kind."""

    def __init__(self, words: list[str], shapes: list[str]) -> None:
        self.words, self.shapes = {w: k for k, w in enumerate(words)}, {s: len(words) + 1 + k for k, s in enumerate(shapes)}
        self.no_word, self.no_shape = len(words), len(words) + 1 + len(shapes)
        self.size = self.no_shape + 1

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = np.fromiter((self.words.get(w.lower(), self.no_word) for w in words), np.int64, len(words))
        looks = np.fromiter((self.shapes.get(shape(w), self.no_shape) for w in words), np.int64, len(words))
        return own, looks


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def word_vectors(keys: Keys, codes: np.ndarray, words: list[str], seed: int = 11) -> np.ndarray:
    """Index vector plus the normed sum of the neighbours' index vectors, for each key."""
    index = index_vectors(keys.size, seed)
    own, looks = (k.astype(np.int32) for k in keys.of(words))
    sums = np.zeros_like(index)
    for kind in (own, looks):
        each = kind[codes]
        for d in range(1, REACH + 1):
            pair, n = np.unique(each[:-d].astype(np.int64) * keys.size + each[d:], return_counts=True)
            for a in range(0, len(pair), PAIRS):
                x, y, many = pair[a : a + PAIRS] // keys.size, pair[a : a + PAIRS] % keys.size, n[a : a + PAIRS, None].astype(np.float32)
                np.add.at(sums, x, many * index[y])
                np.add.at(sums, y, many * index[x])
    vectors = _unit(index) + _unit(sums)
    vectors[keys.no_word] = 0
    return vectors.astype(np.float32)


def pooled(keys: Keys, vectors: np.ndarray, text: pa.Array) -> np.ndarray:
    """Per text: mean vector of its words and shapes, log of its length, share of distinct words, share of repeated lines."""
    words, ends = word_lists(text)
    codes, distinct = coded(words)
    n = np.diff(ends)
    out = np.zeros((len(n), 2 * DIMENSIONS + 3), np.float32)
    if len(codes):
        own, looks = keys.of(distinct)
        each = np.concatenate([vectors[own], vectors[looks]], axis=1)
        full = np.flatnonzero(n)
        out[full, : 2 * DIMENSIONS] = np.add.reduceat(each[codes], ends[:-1][full]) / n[full, None]
        pairs = np.unique(np.repeat(np.arange(len(n)), n) * len(distinct) + codes)
        kinds = np.bincount(pairs // len(distinct), minlength=len(n))
        out[:, -2] = kinds / np.maximum(n, 1)
    out[:, -3] = np.log1p(n) / 10
    lines = [[x for x in t.split("\n") if x] for t in text.to_pylist()]
    out[:, -1] = [1 - len(set(x)) / len(x) if x else 0 for x in lines]
    return out


@dataclass
class Model:
    keys: Keys
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def score(self, text: pa.Array) -> np.ndarray:
        logits = forward(self.layers, (pooled(self.keys, self.vectors, text) - self.centre) / self.scale)[1]
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -30, 30)))


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2[0]


def gradients(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
    """Of the mean log loss plus decay / 2 times the squared weights (not the offsets), by each layer."""
    h, z = forward(layers, x)
    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    back = g[:, None] * layers[2] * (1 - h * h)
    return [x.T @ back + decay * layers[0], back.sum(0), h.T @ g + decay * layers[2], np.array([g.sum()])]


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 300, rate: float = 0.01, decay: float = 1e-3) -> list[np.ndarray]:
    """Adam on the mean log loss with weight decay."""
    rng = np.random.default_rng(5)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, rounds + 1):
        for k, d in enumerate(gradients(layers, x, y, decay)):
            first[k], second[k] = 0.9 * first[k] + 0.1 * d, 0.999 * second[k] + 0.001 * d * d
            layers[k] = layers[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Every fifth row only calibrates the temperature. Without rows of both kinds the score is the labels' mean."""
    arrow, y = pa.array(texts, pa.string()), np.array(labels, float)
    words, _ = word_lists(arrow)
    codes, distinct = coded(words)
    n = np.bincount(codes, minlength=len(distinct))
    by_word, by_shape = Counter(), Counter()
    for w, k in zip(distinct, n.tolist(), strict=True):
        by_word[w.lower()] += k
        by_shape[shape(w)] += k
    top = lambda c, most: [w for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most] if k >= LEAST]
    keys = Keys(top(by_word, VOCABULARY), top(by_shape, SHAPES))
    vectors = word_vectors(keys, codes, distinct) if len(codes) else np.zeros((keys.size, DIMENSIONS), np.float32)
    x = np.concatenate([pooled(keys, vectors, arrow[k : k + 300]) for k in range(0, len(arrow), 300)]) if len(arrow) else np.zeros((0, 2 * DIMENSIONS + 3))
    if len(set(labels)) < 2:
        mean = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        flat = [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), np.array([np.log(mean / (1 - mean))])]
        return Model(keys, vectors, np.zeros(x.shape[1]), np.ones(x.shape[1]), flat, 1.0)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - centre) / scale
    apart = np.arange(len(y)) % 5 == 4
    layers = train(x[~apart], y[~apart])
    z = forward(layers, x[apart])[1]
    temperature = min(np.geomspace(0.25, 8, 60), key=lambda t: log_loss(z / t, y[apart])) if apart.any() else 1.0
    return Model(keys, vectors, centre, scale, layers, float(temperature))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score: the calibrated probability that `label` is 1, for every row of `docs`.

    Only the text is scored; a null text counts as empty and gets a score like any other. Learns from
    at most `most_labelled` rows that are not held out. Repeated rows are scored alike; an empty table gives no rows.
    """
    model = fitted(docs, labels, label, most_labelled, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=400_000):
            scores = model.value.score(plain_text(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores.astype(float))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def keep_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3, label: str = "quality", most_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of `docs`, all columns, whose score is at least `least`."""
    model = fitted(docs, labels, label, most_labelled, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=400_000):
            yield batch.filter(pa.array(model.value.score(plain_text(batch.column("text"))) >= least))

    return docs.mapInArrow(run, docs.schema)

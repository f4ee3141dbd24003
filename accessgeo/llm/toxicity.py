"""Toxic spans by a linear-chain conditional random field over words.

Two states, 1 toxic and 0 other. A word's score for state 1 is the sum of the weights of its hashed
features (the word, its beginnings and ends, its 4-grams of bytes, its length); a 2 x 2 table scores neighbouring
states. Documents carry labels, words do not: words are labelled first by how well their own
features tell toxic documents from others, then the field is fitted to those labels. Marginals from
the forward-backward pass give offending offsets, and their sum and maximum the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix64, plain_text, ragged, slices, word_lists
from .labelled import fitted, held_out

BUCKETS, WIDTH, SPOKEN = 1 << 21, 24, 7
SEGMENT = 200
#: Fitting sees at most so many labelled documents.
MAX_TOXIC = 4_500


def features(words: pa.Array) -> np.ndarray:
    """A row of feature buckets for each word; BUCKETS stands for none. The first SPOKEN columns are the word and its beginnings."""
    low = pc.utf8_trim(pc.utf8_lower(words), ".,;:!?\"'()[]|*#$%&").cast(pa.binary())
    low = low.combine_chunks() if isinstance(low, pa.ChunkedArray) else low
    size = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(low.to_pylist()) + b"\0", np.uint8)
    start = np.cumsum(size) - size
    at = np.arange(WIDTH)
    x = np.where(at < size[:, None], data[np.minimum(start[:, None] + at, len(data) - 1)], 0).astype(np.uint64)
    n = np.minimum(size, WIDTH)
    eight = [sum(x[:, 8 * k + j] << np.uint64(8 * j) for j in range(8)) for k in range(WIDTH // 8)]
    columns = []

    def add(kind: int, value: np.ndarray, there: np.ndarray | bool = True) -> None:
        bucket = mix64(value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0xA0761D6478BD642F % 2**64)) % np.uint64(BUCKETS)
        columns.append(np.where(there, bucket, BUCKETS).astype(np.int32))

    whole = size.astype(np.uint64)
    for part in eight:
        whole = mix64(whole ^ part)
    add(1, whole, size > 0)
    for k in range(3, 9):
        add(k, eight[0] & np.uint64(2 ** (8 * k) - 1), size > k)
    for k in range(3, 6):
        tail = sum(np.take_along_axis(x, np.maximum(n - k + j, 0)[:, None], 1)[:, 0] << np.uint64(8 * j) for j in range(k))
        add(10 + k, tail, (size > k) & (size <= WIDTH))
    for k in range(WIDTH - 3):
        add(20, x[:, k] | x[:, k + 1] << np.uint64(8) | x[:, k + 2] << np.uint64(16) | x[:, k + 3] << np.uint64(24), n >= k + 4)
    add(30, np.minimum(size, 12).astype(np.uint64))
    return np.stack(columns, axis=1)


def _padded(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each position: the sequences that reach it, longest first, so that they form a prefix."""
    n = np.diff(ends)
    order = np.argsort(-n, kind="stable")
    lengths, starts = n[order], ends[:-1][order]
    alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    for t, k in enumerate(alive.tolist()):
        yield t, starts[:k] + t


def forward_backward(odds: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of state 1 to state 0 in the forward and the backward messages at each word; exact for
    sequences of any length. `odds` are exp(emission), `table` exp(transition)."""
    (a, b), (c, d) = table
    ahead, behind = np.empty_like(odds), np.ones_like(odds)
    steps = list(_padded(ends))
    last = None
    for _, at in steps:
        if last is None:
            last = odds[at]
        else:
            r = last[: len(at)]
            last = odds[at] * ((b + d * r) / (a + c * r))
        ahead[at] = last
    for k in range(len(steps) - 1, 0, -1):
        at = steps[k][1]
        r = odds[at] * behind[at]
        behind[at - 1] = (c + d * r) / (a + b * r)
    return ahead, behind


def marginals(odds: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    ahead, behind = forward_backward(odds, ends, table)
    r = ahead * behind
    return r / (1 + r)


def word_labels(codes: np.ndarray, ends: np.ndarray, y: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Distinct words that speak for toxic documents: the word or one of its beginnings is in at least three toxic
    documents of the sample and nearly only there, and far more often than chance would have it."""
    n_words, feats = len(feats), feats[:, :SPOKEN].astype(np.int64)
    doc = np.repeat(np.arange(len(y)), np.diff(ends))
    pairs = np.unique(doc * n_words + codes)
    doc, word = pairs // n_words, pairs % n_words
    toxic, other = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    edges = np.searchsorted(doc, np.arange(0, len(y) + 200, 200))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        seen = np.unique((doc[a:b, None] * (BUCKETS + 1) + feats[word[a:b]]).ravel())
        at, f = seen // (BUCKETS + 1), seen % (BUCKETS + 1)
        toxic += np.bincount(f[y[at] == 1], minlength=BUCKETS + 1)
        other += np.bincount(f[y[at] == 0], minlength=BUCKETS + 1)
    base = max(y.mean(), 1e-6) if len(y) else 0.5
    rate = (toxic + base) / (toxic + other + 1)
    chance = np.sqrt((toxic + other + 1) * base * (1 - base))
    clear = (toxic >= 3) & (rate >= 0.9) & ((toxic - base * (toxic + other)) > 4 * chance)
    clear[BUCKETS] = False
    return clear[feats].any(1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    table: np.ndarray
    head: np.ndarray

    def word_odds(self, words: pa.Array) -> np.ndarray:
        parts = [self.weights[features(words[k : k + 20_000])].sum(1) for k in range(0, len(words), 20_000)]
        return np.exp(np.clip(self.bias + np.concatenate(parts or [np.zeros(0)]), -25, 25))

    def tag(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of state 1 for each word, and the offsets of the texts."""
        words, ends = word_lists(text)
        found = words.dictionary_encode()
        odds = self.word_odds(found.dictionary)
        return marginals(odds[found.indices.to_numpy(zero_copy_only=False)], ends, np.exp(self.table)), ends

    def score(self, text: pa.Array) -> np.ndarray:
        m, ends = self.tag(text)
        z = summary(m, ends) @ self.head[1:] + self.head[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def summary(m: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per document: log of the expected number of toxic words, highest marginal, log of its length."""
    n = np.diff(ends)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), 3))
    if len(full):
        out[full, 0] = np.log1p(np.add.reduceat(m, ends[:-1][full]))
        out[full, 1] = np.maximum.reduceat(m, ends[:-1][full])
    out[:, 2] = np.log1p(n) / 10
    return out


def fit(texts: list[str], labels: list[int], rounds: int = 50, rate: float = 0.15, decay: float = 1e-6) -> Model:
    """Full-batch Adam on the conditional log likelihood of the word labels, over segments of SEGMENT
    words; then a logistic head over the documents' summaries."""
    y = np.array(labels, np.int64)
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    flat = Model(np.zeros(BUCKETS + 1), -4.0, np.zeros((2, 2)), np.array([prior, 0, 0, 0]))
    words, ends = word_lists(pa.array(texts, pa.string()))
    if len(set(labels)) < 2 or not len(words):
        return flat
    found = words.dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    feats = np.concatenate([features(found.dictionary[k : k + 20_000]) for k in range(0, len(found.dictionary), 20_000)])
    spoken = word_labels(codes, ends, y, feats)
    truth = (spoken[codes] & (np.repeat(y, np.diff(ends)) == 1)).astype(float)
    cut = np.unique(np.concatenate([ends, np.arange(0, len(codes), SEGMENT)]))
    # segments with a labelled word and as many without are enough to fit the weights
    marked = np.add.reduceat(truth, cut[:-1]) > 0
    other = np.flatnonzero(~marked)
    other = other[np.argsort(mix64(other.astype(np.uint64)))][: max(int(marked.sum()), 200)]
    use = np.sort(np.concatenate([np.flatnonzero(marked), other]))
    size = np.diff(cut)[use]
    codes, truth = ragged(codes, cut[use], size), ragged(truth, cut[use], size)
    cut = np.concatenate([[0], np.cumsum(size)])
    used, codes = np.unique(codes, return_inverse=True)
    feats = feats[used]
    flat_feats = feats.ravel()
    weights, bias, table = np.zeros(BUCKETS + 1), -3.0, np.zeros((2, 2))
    inner = np.ones(len(codes), bool)
    inner[cut[:-1]] = False
    inner = np.flatnonzero(inner)
    pairs = np.bincount((truth[inner - 1] * 2 + truth[inner]).astype(int), minlength=4).reshape(2, 2)
    moments = [np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0, np.zeros((2, 2)), np.zeros((2, 2))]
    scale = 1 / max(truth.sum(), 1)
    for step in range(1, rounds + 1):
        each = np.clip(bias + weights[feats].sum(1), -25, 25)
        odds, t = np.exp(each)[codes], np.exp(table)
        ahead, behind = forward_backward(odds, cut, t)
        r = ahead * behind
        miss = r / (1 + r) - truth
        p, q = ahead[inner - 1], odds[inner] * behind[inner]
        joint = [np.full_like(p, t[0, 0]), t[0, 1] * q, t[1, 0] * p, t[1, 1] * p * q]
        whole = sum(joint)
        expected = np.array([(x / whole).sum() for x in joint]).reshape(2, 2)
        by_word = np.bincount(codes, miss, len(feats))
        by_feature = np.bincount(flat_feats, np.repeat(by_word, feats.shape[1]), BUCKETS + 1)
        by_feature[BUCKETS] = 0
        grads = [by_feature * scale + decay * weights, miss.sum() * scale, (expected - pairs) * scale]
        values = [weights, bias, table]
        for k, g in enumerate(grads):
            moments[2 * k], moments[2 * k + 1] = 0.9 * moments[2 * k] + 0.1 * g, 0.999 * moments[2 * k + 1] + 0.001 * g * g
            values[k] = values[k] - rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
        weights, bias, table = values
    model = Model(weights.astype(np.float32), float(bias), np.clip(table, -4, 4), flat.head)
    x = np.concatenate([summary(*model.tag(pa.array(texts[k : k + 200], pa.string()))) for k in range(0, len(texts), 200)])
    model.head = logistic(np.c_[np.ones(len(y)), x], y, flat.head)
    return model


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton steps on the log loss with a ridge, halved until they lower it."""
    def loss(h: np.ndarray) -> float:
        z = x @ h
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * ((h - start)[1:] ** 2).sum())

    head, hold = start.copy(), ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (p - y) + hold @ (head - start))
        while loss(head - step) > loss(head) and np.abs(step).max() > 1e-9:
            step = step / 2
        head = head - step
        if np.abs(step).max() < 1e-6:
            break
    return head


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_labelled: int = MAX_TOXIC) -> DataFrame:
    """doc_id, held_out, score: probability that a document is toxic, for every row of `docs`.

    Only the text is scored, whole; null counts as empty. Learns from at most `most_labelled` rows
    that are not held out; without both labels the score is their rate. Repeated rows are scored alike;
    an empty table gives no rows.
    """
    model = fitted(docs, labels, label, most_labelled, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.value.score(plain_text(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores.astype(float))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def toxic_spans(docs: DataFrame, labels: DataFrame, label: str = "toxic", least: float = 0.5, most_labelled: int = MAX_TOXIC) -> DataFrame:
    """doc_id, word_index, word, marginal of each word whose marginal is at least `least`."""
    model = fitted(docs, labels, label, most_labelled, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = plain_text(batch.column("text"))
            m, ends = model.value.tag(text)
            at = np.flatnonzero(m >= least)
            doc = np.searchsorted(ends, at, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array((at - ends[doc]).astype(np.int64)), word_lists(text)[0].take(pa.array(at)), pa.array(m[at].astype(float))], ["doc_id", "word_index", "word", "marginal"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, word_index bigint, word string, marginal double")

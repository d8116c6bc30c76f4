"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A word has two tokens: its hashed lower-cased form and its shape (case, digits, symbols, length,
equality with the previous word). Each token bucket owns a sparse ternary index vector; its context
vector is the sum of the index vectors of its neighbours over the training texts. A document is the
mean of its tokens' index and context vectors plus its log length. The network has one hidden layer;
its temperature is fitted on training rows kept back from the weights.

Fitting uses at most ``training.MAX_ROWS`` labelled rows, each text whole; every text is scored whole.
Defined cases: null and empty texts pool to zero and still get a score; with labels of one class only,
every score is that class's share; with none, 0.5; a score of exactly 0.5 predicts 1; repeated rows are
scored each; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, map_slices, pieces, trim
from .training import fold, labelled_sample, sigmoid

FOLDS, HELD = 3, 1
BITS, SHAPES, DIM, WINDOW = 14, 1024, 48, 2
HIDDEN = 24

_KIND = np.zeros((256, 5), np.int32)  # upper, letter, digit, symbol, other punctuation
_KIND[65:91, 0] = 1
_KIND[65:91, 1] = _KIND[97:123, 1] = _KIND[128:, 1] = 1
_KIND[48:58, 2] = 1
_KIND[list(b"#*$%&|<>=+^~\\_@{}[]"), 3] = 1
_KIND[list(b".,;:!?'\"-()/"), 4] = 1


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word bucket, shape bucket) of every word."""
    h = words.hashes(lower=True)
    run = np.zeros((len(words.data) + 1, 5), np.int32)
    np.cumsum(_KIND[words.data], axis=0, out=run[1:])
    n = run[words.ends] - run[words.starts]
    upper, letter, digit, symbol, mark = n.T
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    shape = np.minimum(upper, 2) + 3 * (letter > 0) + 6 * np.minimum(digit, 1) + 12 * np.minimum(symbol, 2) + 36 * np.minimum(mark, 2) + 108 * same
    shape = shape * 4 + np.digitize(words.ends - words.starts, (3, 7, 14))
    return (h >> U64(64 - BITS)).astype(np.int64), shape.astype(np.int64)


class Model:
    def __init__(self, texts: pa.Array, y: np.ndarray) -> None:
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.Generator(np.random.Philox(8))
        size = (1 << BITS) + SHAPES
        index = rng.choice(np.array([-1, 0, 0, 0, 1], np.float32), (size, DIM))
        context = np.zeros((size, DIM), np.float32)
        for _, part in pieces(texts):
            self._add_contexts(part, index, context)
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        self.vectors = np.hstack([index, context / np.maximum(norm, 1e-6)]).astype(np.float32)
        x = np.concatenate([self.pool(part) for _, part in pieces(texts)])
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.std
        back = np.arange(len(y)) % 5 == 4
        self._fit(x[~back], y[~back].astype(np.float64), rng)
        self.temperature = 1.0
        if 0 < y[back].sum() < back.sum():
            z = self._logit(x[back])
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, -(2 * y[back] - 1) * z / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    @staticmethod
    def _add_contexts(texts: pa.Array, index: np.ndarray, context: np.ndarray) -> None:
        """Add the index vectors of each token's neighbours to its context vector."""
        words = Words(texts)
        word, shape = tokens(words)
        stream, step = shape + (1 << BITS), 1 << 16
        for d in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
            for a in range(0, len(word), step):
                i = np.arange(max(a, -d, 0), min(a + step, len(word) - max(d, 0)))
                i = i[words.doc[i] == words.doc[i + d]]
                near = index[stream[i + d]] + index[word[i + d]]
                np.add.at(context, word[i], near)
                np.add.at(context, stream[i], near)

    def pool(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts)
        word, shape = tokens(words)
        out = np.zeros((len(words.counts), 2 * self.vectors.shape[1] + 1), np.float32)
        half, step = self.vectors.shape[1], 1 << 15
        for a in range(0, len(word), step):
            b = min(len(word), a + step)
            docs, at = np.unique(words.doc[a:b], return_index=True)
            out[docs, :half] += np.add.reduceat(self.vectors[word[a:b]], at, axis=0)
            hist = np.zeros((len(docs), SHAPES), np.float32)
            np.add.at(hist, (np.searchsorted(docs, words.doc[a:b]), shape[a:b]), 1)
            out[docs, half : 2 * half] += hist @ self.vectors[1 << BITS :]
        out[:, :-1] /= np.maximum(1, words.counts)[:, None]
        out[:, -1] = np.log1p(words.counts)
        return out

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) ** 0.5
        for step in range(1, 401):
            rows = rng.integers(0, len(y), 256)
            h = np.tanh(x[rows] @ p[0] + p[1])
            d = (sigmoid(h @ p[2] + p[3]) - y[rows]) * weight[rows] / len(rows)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[rows].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            for a, g, mm, vv in zip(p, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= 0.01 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self.net = p

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.net
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = (self.pool(texts) - self.mean) / self.std
        return sigmoid(self._logit(x) / self.temperature)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD)
    model = Model(sample["text"].combine_chunks() if len(sample) else pa.array([], pa.string()), sample["y"].to_numpy())
    del sample
    trim()
    return model


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = sent.value.score(batch.column("text"))
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", fold(F.col("doc_id"), FOLDS, HELD).alias("held_out"))
    return map_slices(rows, kernel, "doc_id long, held_out boolean, score double, predicted int")

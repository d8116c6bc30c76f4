"""Fitting in the driver on a bounded sample of labelled rows: sampling, linear SVM, logistic scale."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of every training sample: labelled rows, each with its whole text.
MAX_ROWS = 3000


def fold(doc_id: Column, folds: int, held: int) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo ``folds``, equals ``held``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = MAX_ROWS) -> pa.Table:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out fold, by doc_id.

    The documents are the first by a hash of the id. Of several labels or texts of one doc_id the
    smallest counts, so every run takes the same sample.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    picked = known.where(~fold(F.col("id"), folds, held)).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    # at most ``rows`` narrow rows: a broadcast of known size
    joined = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null").join(F.broadcast(picked), "id")
    found = joined.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return found.select(F.col("id").alias("doc_id"), "text", "y").toArrow().sort_by("doc_id")


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60, weigh: bool = True) -> tuple[np.ndarray, float]:
    """(weights, bias) of an L2 linear SVM with squared hinge loss; y is +1 or -1. Dual coordinate steps."""
    gram = (x @ x.T + 1).astype(np.float64)  # 1: the bias as a further feature
    gram *= y[:, None]
    gram *= y
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean()) if weigh else np.full(len(y), 0.5)
    diagonal = share / c
    alpha, grad = np.zeros(len(y)), -np.ones(len(y))
    rng = np.random.Generator(np.random.Philox(5))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = max(0.0, alpha[i] - (grad[i] + diagonal[i] * alpha[i]) / (gram[i, i] + diagonal[i]))
            step = new - alpha[i]
            if abs(step) > 1e-9:
                grad += gram[i] * step
                alpha[i] = new
                moved = max(moved, abs(step) * gram[i, i])
        if moved < 1e-3:
            break
    signed = alpha * y
    return signed @ x, float(signed.sum())


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) of a logistic model by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + l2 * len(x) * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + l2 * len(x) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w

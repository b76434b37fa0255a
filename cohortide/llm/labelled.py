"""Bounded samples of labelled documents, held-out rows, and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_FINE = 1 << 30


def held_out(doc_id) -> Column:
    """Whether labels of this document must not be learnt from: crc32 of the id mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id") -> DataFrame:
    """``sample_id`` and ``label`` of labelled documents that may be learnt from.

    All of them up to ``bound``; of more, those with the lowest hashes, about ``bound``. The sample
    is so small that it can be broadcast. A document labelled twice counts with its larger label.
    """
    rows = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()
                         & ~held_out(F.col(doc_id)))
            .groupBy(F.col(doc_id).alias("sample_id")).agg(F.max(label).cast("int").alias("label")))
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(5), "sample_id"), F.lit(_FINE)) < bound * _FINE // n)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of standardised features and the intercept, folded back to the given features."""
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(y))])
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep),
                               z.T @ (y - p) - keep * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name

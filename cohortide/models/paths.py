"""Regularisation paths of the linear models over all folds, from one pass over the rows.

A linear fit needs no more of the rows than their sums of products, and those of all folds but one are
the total less that one's. So one aggregation by fold gives every training and every validation part,
and all grid points are solved on small matrices: 51 by 51 for the full features, whatever the number
of rows. Coefficients follow down the path from the largest penalty on, each solution the start of the
next (coordinate descent). Objective and penalties are those of ``estimators.linear``: with s the
label's deviation, half the mean squared error + mix * reg * |w| + (1 - mix) * reg / s * |w|^2 / 2.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortide.params import TARGET

TOLERANCE = 1e-10
MAX_SWEEPS = 20_000


@dataclass(frozen=True)
class Moments:
    """Sums of products of (1, features, target): ``table[i, j]`` is the sum of column i times j."""

    table: np.ndarray

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.table - other.table)

    @property
    def rows(self) -> int:
        return int(round(self.table[0, 0]))

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Covariances of the features and with the target, means, and the target's deviation."""
        n = self.table[0, 0]
        mean = self.table[0] / n
        cov = self.table / n - np.outer(mean, mean)
        return cov[1:-1, 1:-1], cov[1:-1, -1], mean, float(np.sqrt(max(cov[-1, -1], 0.0)))

    def rmse(self, coefficients: np.ndarray, intercept: float) -> float:
        error = np.concatenate([[intercept], coefficients, [-1.0]])
        return float(np.sqrt(max(error @ self.table @ error, 0.0) / self.table[0, 0]))


def fold_moments(rows: DataFrame, features: Sequence[str], folds: int, target: str = TARGET) -> list[Moments]:
    """Moments of each fold. ``rows`` have the features, the target and ``fold`` as columns.

    Each task adds up its rows; what is shuffled and returned is bounded by the features' number."""
    names = [*features, target]
    size = len(names) + 1

    def add(batches):
        sums = np.zeros((folds, size, size))
        for batch in batches:
            fold = np.asarray(batch.column("fold"))
            x = np.column_stack([np.ones(batch.num_rows), *[np.asarray(batch.column(c)) for c in names]])
            for k in np.unique(fold):
                own = x[fold == k]
                sums[k] += own.T @ own
        for k in range(folds):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([sums[k].ravel()], pa.list_(pa.float64()))],
                ["fold", "sums"])

    parts = rows.select(F.col("fold").cast("int"), *[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(
        add, "fold int, sums array<double>")
    total = parts.select("fold", F.posexplode("sums")).groupBy("fold", "pos").agg(F.sum("col").alias("sum"))
    tables = np.zeros((folds, size * size))
    for r in total.collect():
        tables[r["fold"], r["pos"]] = r["sum"]
    return [Moments(t.reshape(size, size)) for t in tables]


def solve(moments: Moments, reg: float, mix: float, start: np.ndarray | None = None
          ) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of one fit; ``start`` is where the descent begins."""
    gram, cross, mean, deviation = moments.centred()
    n = len(cross)
    # A feature without spread, or a target without one, has no coefficient.
    live = np.flatnonzero(np.diag(gram) > 1e-12 * np.maximum(mean[1:-1] ** 2, 1e-300))
    w = np.zeros(n)
    if len(live) and deviation > 0:
        flat, ridge = mix * reg, (1 - mix) * reg / deviation
        g, c = gram[np.ix_(live, live)], cross[live]
        if flat == 0:
            w[live] = np.linalg.lstsq(g + ridge * np.eye(len(live)), c, rcond=None)[0]
        else:
            w[live] = _descend(g, c, flat, ridge, np.zeros(len(live)) if start is None else start[live])
    return w, float(mean[-1] - mean[1:-1] @ w)


def _descend(gram, cross, flat: float, ridge: float, w: np.ndarray) -> np.ndarray:
    """Cyclic coordinate descent: each coefficient in turn to its optimum given the others.

    Sweeps alone take thousands of rounds where features hang together. So each is followed by exact
    steps of the coefficients that it left nonzero, all at once; none of them raises the objective."""
    w = w.copy()
    left = cross - gram @ w
    diagonal = np.diag(gram)
    scale = np.sqrt(diagonal)
    for _ in range(MAX_SWEEPS):
        most = 0.0
        for j in range(len(w)):
            pull = left[j] + diagonal[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - flat, 0.0) / (diagonal[j] + ridge)
            step = new - w[j]
            if step:
                w[j] = new
                left -= gram[:, j] * step
                most = max(most, abs(step) * scale[j])
        if most <= TOLERANCE * (1.0 + np.abs(w * scale).max()):
            break
        w = _settle(gram, cross, flat, ridge, w)
        left = cross - gram @ w
    return w


def _settle(gram, cross, flat: float, ridge: float, w: np.ndarray) -> np.ndarray:
    """The optimum for the signs of ``w``. Where a coefficient would change its sign on the way there, it
    stops at 0 and the others go on without it."""
    w = w.copy()
    for _ in range(len(w)):
        on = np.flatnonzero(w)
        if not len(on):
            break
        scale = np.sqrt(np.diag(gram)[on] + ridge)
        slope = cross[on] - gram[on] @ w - ridge * w[on] - flat * np.sign(w[on])
        hessian = (gram[np.ix_(on, on)] + ridge * np.eye(len(on))) / np.outer(scale, scale)
        step = np.linalg.lstsq(hessian, slope / scale, rcond=1e-12)[0] / scale
        turns = w[on] * (w[on] + step) < 0
        if not turns.any():
            w[on] += step
            break
        part = np.where(turns, -w[on] / np.where(turns, step, 1.0), np.inf)
        first = int(part.argmin())
        w[on] += part[first] * step
        w[on[first]] = 0.0
    return w


def path(moments: Moments, regs: Sequence[float], mix: float) -> dict[float, tuple[np.ndarray, float]]:
    """Fits for all penalties, the largest first."""
    out, start = {}, None
    for reg in sorted(set(regs), reverse=True):
        out[reg] = solve(moments, reg, mix, start)
        start = out[reg][0]
    return out


def cross_validated(moments: Sequence[Moments], points: Sequence[tuple[float, float]]
                    ) -> list[tuple[float, list[float]]]:
    """For each (reg, mix) the mean RMSE and those of the folds that have rows."""
    total = Moments(np.sum([m.table for m in moments], axis=0))
    scores: list[list[float]] = [[] for _ in points]
    for held in moments:
        if not held.rows:
            continue
        train = total - held
        paths = {mix: path(train, [r for r, m in points if m == mix], mix) for mix in {m for _, m in points}}
        for own, (reg, mix) in zip(scores, points):
            own.append(held.rmse(*paths[mix][reg]))
    return [(float(np.mean(own)) if own else float("nan"), own) for own in scores]

"""Searches of a settings grid over folds, fit by fit, through a ledger.

``search`` runs the fits that the ledger lacks, some at a time. Each trains on all folds but one and is
scored on that one. The rows are stored once, in as many partitions as their number calls for: a level
of a tree is a job over all of them, so a small table in many partitions costs far more than its work.

Trees need no fit for each depth. A tree of at most d levels is the deeper tree cut at level d, as
splits are chosen from the top and a node keeps the prediction it would make as a leaf. So one fit
scores all depths of a grid. For a decision tree the scores are those of separate fits. A forest draws
features for each node, in an order that depends on the depth: its cut trees are trees of a forest of
that depth, with other draws than a separate fit with the same seed would make. ``nested=False`` fits
every point by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortide.models import estimators as est, paths
from cohortide.models.ledger import TrialLedger, settings_key, study_of
from cohortide.models.prepare import FEATURES, MODEL_SEED, assembler, with_fold
from cohortide.params import TARGET, CohortParams
from cohortide.session import materialize, scratch_path

#: Rows of a partition that fits iterate over, and scores that are appended together.
ROWS_PER_PARTITION = 50_000
FLUSH = 32
FOLDS = 10


def grid_points(grid: Mapping[str, Sequence]) -> list[dict[str, object]]:
    """Every combination, the first setting varying slowest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def fold_rows(train: DataFrame, params: CohortParams, folds: int = FOLDS) -> DataFrame:
    """Features, target and fold of the training rows, written once in partitions of a fitting number."""
    rows = with_fold(assembler(params.feature_columns, FEATURES).transform(train.drop(FEATURES)), folds).select(
        FEATURES, TARGET, "fold")
    stored = materialize(rows, "fold-rows")
    parts = max(1, -(-stored.count() // ROWS_PER_PARTITION))
    return materialize(stored.coalesce(parts), "fold-rows")


def squares(prediction: Column) -> Column:
    error = prediction - F.col(TARGET)
    return F.sqrt(F.avg(error * error))


def score(model: Model, rows: DataFrame) -> tuple[float, int]:
    """RMSE and number of rows; of no rows 0 and 0."""
    out = model.transform(rows).agg(squares(F.col("prediction")), F.count(F.lit(1))).first()
    return float(out[0] or 0.0), int(out[1])


# --- depths of a tree ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Nodes:
    """The nodes of all trees of a model as arrays. Of a leaf, left and right are the leaf itself."""

    roots: np.ndarray
    prediction: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def by_depth(self, x: np.ndarray, depths: Sequence[int]) -> np.ndarray:
        """For each row of ``x`` the mean prediction of the trees cut at each of the depths."""
        at = np.tile(self.roots, (len(x), 1))
        rows, out = np.arange(len(x))[:, None], np.empty((len(x), len(depths)))
        for depth in range(max(depths) + 1):
            for k, wanted in enumerate(depths):
                if wanted == depth:
                    out[:, k] = self.prediction[at].mean(1)
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return out


def node_table(model: Model, path: str) -> Nodes:
    """From the node rows that the model saves; at most trees times 2 ** (depth + 1), whatever the data."""
    spark = SparkSession.active()
    model.write().overwrite().save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "nodeData" in stored.columns:
        stored = stored.select("treeID", "nodeData.*")
    else:
        stored = stored.withColumn("treeID", F.lit(0))
    split = F.col("split")
    table = stored.select(
        "treeID", "id", "prediction", "leftChild", "rightChild", split["featureIndex"].alias("feature"),
        F.try_element_at(split["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold")).toPandas()
    table = table.sort_values(["treeID", "id"], ignore_index=True)
    # Ids number the nodes of a tree from 0, so a child stands as far from its tree's first row.
    first = table.groupby("treeID")["id"].transform("size").groupby(table["treeID"]).first().cumsum()
    base = table["treeID"].map(first.shift(fill_value=0)).to_numpy()
    leaf = (table["leftChild"] < 0).to_numpy()
    own = np.arange(len(table))
    return Nodes(np.flatnonzero((table["id"] == 0).to_numpy()), table["prediction"].to_numpy(float),
                 np.where(leaf, 0, table["feature"]).astype(np.int64),
                 np.where(leaf, 0.0, table["threshold"].astype(float)),
                 np.where(leaf, own, base + table["leftChild"]).astype(np.int64),
                 np.where(leaf, own, base + table["rightChild"]).astype(np.int64))


def score_depths(model: Model, rows: DataFrame, depths: Sequence[int]) -> list[tuple[float, int]]:
    """RMSE and number of rows of the model with its trees cut at each depth, in one pass over the rows."""
    nodes = node_table(model, scratch_path(rows.sparkSession, "nodes"))

    def add(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
            y = np.asarray(batch.column("y"), float)
            error = nodes.by_depth(x, depths) - y[:, None] if len(y) else np.zeros((0, len(depths)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(error ** 2).sum(0)], pa.list_(pa.float64())), pa.array([len(y)], pa.int64())],
                ["squares", "n"])

    parts = rows.select(vector_to_array(FEATURES).alias("x"), F.col(TARGET).cast("double").alias("y")).mapInArrow(
        add, "squares array<double>, n long")
    total = parts.agg(*[F.sum(F.col("squares")[k]).alias(f"d{k}") for k in range(len(depths))],
                      F.sum("n").alias("n")).first()
    n = total["n"] or 0
    return [((total[k] / n) ** 0.5 if n else 0.0, int(n)) for k in range(len(depths))]


# --- searches -----------------------------------------------------------------------------------

def search(kind: str, rows: DataFrame, params: CohortParams, grid: Mapping[str, Sequence],
           ledger: TrialLedger, folds: int = FOLDS, parallelism: int = 8,
           after: Callable[[int], None] | None = None, nested: bool = True) -> DataFrame:
    """Mean score of every grid point, in grid order: grid_index, settings, rmse.

    ``rows`` are ``fold_rows``. ``after`` is called with the number of fits so far, and may raise to
    stop; what has been appended by then stays. A fold without rows is left out of the means.
    """
    maker = {"decision_tree": est.tree, "random_forest": est.forest}.get(kind)
    estimator = maker() if maker else est.linear(kind)
    nested = nested and maker is not None and "maxDepth" in grid
    study = study_of(rows, params.feature_columns, folds, MODEL_SEED, nested and kind == "random_forest")
    points = grid_points(grid)
    known = ledger.finished(study, kind)
    todo = {}
    for point, fold in product(points, range(folds)):
        if (settings_key(point), fold) not in known:
            shared = {k: v for k, v in point.items() if not (nested and k == "maxDepth")}
            todo.setdefault((settings_key(shared), fold), []).append(point)

    def fit(fold: int, own: list[dict]) -> list[tuple[str, int, float, int]]:
        held = rows.where(F.col("fold") == fold)
        deepest = max(own, key=lambda p: p.get("maxDepth", 0))
        model = estimator.copy({estimator.getParam(k): v for k, v in deepest.items()}).fit(
            rows.where(F.col("fold") != fold))
        if nested:
            scores = score_depths(model, held, [p["maxDepth"] for p in own])
        else:
            scores = [score(model, held)]
        return [(settings_key(p), fold, *s) for p, s in zip(own, scores)]

    rows.persist()
    pending, done = [], 0
    pool = ThreadPoolExecutor(parallelism)
    try:
        run = inheritable_thread_target(rows.sparkSession)(fit)
        running = [pool.submit(run, fold, own) for (_, fold), own in todo.items()]
        for future in as_completed(running):
            pending += future.result()
            done += 1
            if len(pending) >= FLUSH or done == len(running):
                ledger.append(study, kind, pending)
                pending = []
            if after:
                after(done)
    finally:
        pool.shutdown(cancel_futures=True)
        rows.unpersist()
    return grid_scores(ledger, study, kind, points)


def grid_scores(ledger: TrialLedger, study: str, kind: str, points: list[dict]) -> DataFrame:
    spark = ledger.spark
    wanted = spark.createDataFrame(
        [(i, settings_key(p), {k: float(v) for k, v in p.items()}) for i, p in enumerate(points)],
        "grid_index int, key string, settings map<string,double>")
    means = ledger.scores(study, kind).where("rows > 0").groupBy(F.col("settings").alias("key")).agg(
        F.avg("rmse").alias("rmse"))
    return wanted.join(means, "key", "left").select("grid_index", "settings", "rmse").orderBy("grid_index")


def best_point(results: DataFrame) -> dict[str, float]:
    """Settings of the least score; of equal ones the first in grid order."""
    return results.orderBy(F.col("rmse").asc_nulls_last(), "grid_index").first()["settings"]


def refit(kind: str, point: Mapping[str, float], train: DataFrame) -> Model:
    """The estimator with a grid point's settings, fitted on all of ``train`` (with vectors)."""
    maker = {"decision_tree": est.tree, "random_forest": est.forest}.get(kind)
    estimator = maker() if maker else est.linear(kind)
    typed = {estimator.getParam(k): type(estimator.getOrDefault(k))(v) for k, v in point.items()}
    return estimator.copy(typed).fit(train)


def search_linear(kind: str, train: DataFrame, params: CohortParams, grid: Mapping[str, Sequence],
                  folds: int = FOLDS) -> DataFrame:
    """As ``search`` of a linear model, but all points and folds from one pass over ``train``."""
    points = grid_points(grid)
    rows = with_fold(train.drop(FEATURES), folds)
    moments = paths.fold_moments(rows, params.feature_columns, folds)
    mixes = [(float(p["regParam"]), float(p.get("elasticNetParam", est.LINEAR_MIX[kind]))) for p in points]
    scores = paths.cross_validated(moments, mixes)
    out = [(i, {k: float(v) for k, v in p.items()}, score) for i, (p, (score, _)) in enumerate(zip(points, scores))]
    return train.sparkSession.createDataFrame(out, "grid_index int, settings map<string,double>, rmse double")

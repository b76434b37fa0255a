"""Train, tune and compare the regressors on a wide feature table."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame

from cohortide.models import estimators as est
from cohortide.models.prepare import (minmax_pipeline, pca_pipeline, reduced_features, split,
                                      vectors)
from cohortide.params import CohortParams
from cohortide.session import materialize


def training_parts(wide: DataFrame, params: CohortParams, scaled: bool = False
                   ) -> tuple[DataFrame, DataFrame]:
    """Train and test parts with feature vectors, written once: every fit iterates over them.

    The scaler, when asked for, is fitted on the training part only.
    """
    train, test = split(materialize(wide, "wide"))
    if scaled:
        scaler = minmax_pipeline(params).fit(train)
        parts = scaler.transform(train), scaler.transform(test)
    else:
        parts = vectors(train, params), vectors(test, params)
    return materialize(parts[0], "train"), materialize(parts[1], "test")


def evaluate(models: dict[str, Model], rows: DataFrame, part: str) -> list[tuple]:
    evaluator = est.rmse_evaluator()
    return [(name, part, float(evaluator.evaluate(m.transform(rows))))
            for name, m in models.items()]


def compare_default_models(train: DataFrame, test: DataFrame, holdout: DataFrame | None = None
                           ) -> DataFrame:
    """RMSE on all given parts of the mean baseline, every model at its default settings and the
    chosen forest."""
    parts = {"train": train, "test": test} | ({} if holdout is None else {"holdout": holdout})
    spark = train.sparkSession
    models = {kind: est.linear(kind).fit(train) for kind in est.LINEAR_MIX}
    models["decision_tree"] = est.tree().fit(train)
    models["random_forest"] = est.forest().fit(train)
    models["chosen_forest"] = est.forest(**est.CHOSEN_FOREST).fit(train)
    evaluator = est.rmse_evaluator()
    rows = [("baseline", part, float(evaluator.evaluate(est.baseline(train, data))))
            for part, data in parts.items()]
    for part, data in parts.items():
        rows += evaluate(models, data, part)
    return spark.createDataFrame(rows, "model string, part string, rmse double")


def tune(kind: str, wide_train: DataFrame, params: CohortParams, grid: dict, folds: int = 10,
         parallelism: int = 8):
    """Cross-validate one model family; returns the search result and the refitted best model."""
    raw = wide_train.drop("features")
    makers = {"decision_tree": est.tree, "random_forest": est.forest}
    maker = makers.get(kind)
    estimator = maker() if maker else est.linear(kind)
    search = est.cross_validate(estimator, raw, grid, params, folds, parallelism)
    if maker is None:
        return search, search.bestModel.stages[-1]
    refit = maker(**{k: v for k, v in est.best_settings(search).items()
                     if k not in ("labelCol", "featuresCol")})
    return search, refit.fit(vectors(raw, params))


def pca_tree(wide: DataFrame, params: CohortParams):
    """Decision tree on session averages and four components; returns model, PCA and parts.

    The components are fitted on all rows, before the split, as in the analysis this follows."""
    pca = pca_pipeline(params).fit(wide)
    train, test = split(reduced_features(wide, pca))
    return est.tree("reduced_features").fit(train), pca, train, test

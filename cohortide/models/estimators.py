"""Regressors, tuning grids, evaluation and persistence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import (DecisionTreeRegressionModel, DecisionTreeRegressor,
                                   LinearRegression, LinearRegressionModel,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide.models.prepare import FEATURES, MODEL_SEED, assembler, with_fold
from cohortide.params import TARGET, CohortParams
from cohortide.sources.tables import read_params, write_params

# Model settings and tuning grids.
LINEAR_MIX = {"lasso": 1.0, "ridge": 0.0, "elastic_net": 0.5}
LASSO_GRID = {"regParam": [0.1, 0.5, 1.0, 5.0, 10.0]}
RIDGE_GRID = {"regParam": [0.1, 0.5, 1.0, 5.0, 10.0]}
RIDGE_SECOND_GRID = {"regParam": [10.0, 15.0, 20.0, 25.0, 30.0]}
ELASTIC_GRID = {"regParam": [0.1, 0.5, 1.0, 5.0, 10.0],
                "elasticNetParam": [0.1, 0.3, 0.5, 0.7, 0.9]}
TREE_GRID = {"maxBins": [4, 8, 16, 32], "maxDepth": list(range(2, 10)),
             "minInstancesPerNode": [1, 10, 50, 100]}
FOREST_GRID = {"maxBins": [8, 16, 32], "maxDepth": list(range(2, 10)),
               "minInstancesPerNode": [1, 10, 50, 100], "numTrees": [20, 50, 100]}
CHOSEN_FOREST = {"maxDepth": 7, "numTrees": 100, "maxBins": 32, "minInstancesPerNode": 10,
                 "impurity": "variance", "subsamplingRate": 1.0, "minInfoGain": 0.0,
                 "featureSubsetStrategy": "auto", "maxMemoryInMB": 256, "checkpointInterval": 10,
                 "cacheNodeIds": False}


def linear(kind: str, features: str = FEATURES, reg_param: float = 1.0) -> LinearRegression:
    """Lasso, ridge or elastic net by name."""
    return LinearRegression(labelCol=TARGET, featuresCol=features, regParam=reg_param,
                            elasticNetParam=LINEAR_MIX[kind], standardization=False,
                            maxIter=10000)


def tree(features: str = FEATURES, **settings) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(labelCol=TARGET, featuresCol=features,
                                 **{"seed": MODEL_SEED, **settings})


def forest(features: str = FEATURES, **settings) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=TARGET, featuresCol=features,
                                 **{"seed": MODEL_SEED, **settings})


def rmse_evaluator() -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=TARGET, predictionCol="prediction", metricName="rmse")


def baseline(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Predict the training mean for every row; the mean stays a scalar subquery of the plan."""
    mean = train.agg(F.avg(TARGET).alias("m")).scalar()
    return rows.withColumn("prediction", mean)


def rmse_table(rows: DataFrame) -> DataFrame:
    error = F.col("prediction") - F.col(TARGET)
    return rows.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("rows"))


def cross_validate(estimator: Estimator, train: DataFrame, grid: Mapping[str, Sequence],
                   params: CohortParams, folds: int = 10, parallelism: int = 8
                   ) -> CrossValidatorModel:
    """Tune by cross-validated RMSE. Folds follow the cohort key, so they do not move with the
    partitioning. ``train`` must be materialised: each fold is a filter over it. Vectors are
    assembled once, as the assembler learns nothing, and cached while the search runs."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    features = estimator.getFeaturesCol()
    rows = with_fold(assembler(params.feature_columns, features).transform(train), folds).select(
        features, TARGET, "fold").cache()
    search = CrossValidator(
        estimator=Pipeline(stages=[estimator]), estimatorParamMaps=builder.build(),
        evaluator=rmse_evaluator(), numFolds=folds, seed=MODEL_SEED, foldCol="fold",
        parallelism=parallelism)
    try:
        return search.fit(rows)
    finally:
        rows.unpersist()


def cv_results(spark: SparkSession, model: CrossValidatorModel) -> DataFrame:
    """One row per grid point, in grid order."""
    rows = [(i, {p.name: float(v) for p, v in point.items()}, float(score))
            for i, (point, score) in enumerate(zip(model.getEstimatorParamMaps(),
                                                   model.avgMetrics))]
    return spark.createDataFrame(rows, "grid_index int, settings map<string,double>, rmse double")


def around_best(results: DataFrame) -> DataFrame:
    """The best grid point and its neighbours in grid order, as far as they exist."""
    best = results.select(F.min_by("grid_index", F.struct("rmse", "grid_index"))).scalar()
    return results.where(F.abs(F.col("grid_index") - best) <= 1)


def settings_of(model: Model) -> dict[str, object]:
    """All settings of a fitted model by name."""
    return {p.name: v for p, v in model.extractParamMap().items()}


def settings_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = sorted((k, str(v)) for k, v in settings_of(model).items())
    return spark.createDataFrame(rows, "name string, value string")


def best_settings(model: CrossValidatorModel, features: str = FEATURES) -> dict[str, object]:
    """Settings of the winning regressor, ready to build an estimator that is refit on the whole
    training part."""
    return {**settings_of(model.bestModel.stages[-1]), "labelCol": TARGET,
            "featuresCol": features, "seed": MODEL_SEED}


MODELS = {"RandomForestRegressionModel": RandomForestRegressionModel,
          "DecisionTreeRegressionModel": DecisionTreeRegressionModel,
          "LinearRegressionModel": LinearRegressionModel}


def save_model(model: Model, path: str, params: CohortParams) -> None:
    """Save a regressor together with its kind and the feature order it was trained on."""
    model.write().overwrite().save(f"{path}/model")
    about = {"features": list(params.feature_columns), "kind": type(model).__name__}
    write_params(SparkSession.active(), about, f"{path}/features")


def load_model(spark: SparkSession, path: str, params: CohortParams) -> Model:
    stored = read_params(spark, f"{path}/features")
    if stored["features"] != list(params.feature_columns):
        raise ValueError("the model was trained on another feature order")
    return MODELS[stored["kind"]].load(f"{path}/model")


save_forest, load_forest = save_model, load_model

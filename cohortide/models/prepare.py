"""Feature vectors, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, Normalizer, PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortide.functions.columns import stable_bucket
from cohortide.params import COHORT_KEY, SESSION_AVERAGES, CohortParams

FEATURES = "features"
# Seeds of the split and of the models.
SPLIT_SEED = 143
MODEL_SEED = 511


def assembler(columns: Sequence[str], output: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output)


def vectors(df: DataFrame, params: CohortParams, output: str = FEATURES) -> DataFrame:
    """Every declared feature, in declared order, as one vector."""
    return assembler(params.feature_columns, output).transform(df)


def minmax_pipeline(params: CohortParams, output: str = FEATURES) -> Pipeline:
    """Scale every feature to 0..1: one assembler and one scaler, so a single pass to fit."""
    return Pipeline(stages=[
        assembler(params.feature_columns, "raw_features"),
        MinMaxScaler(inputCol="raw_features", outputCol=output)])


def vector_columns(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Vector elements as double columns, without a Python round trip."""
    parts = vector_to_array(F.col(vector))
    return df.withColumns({name: parts[i] for i, name in enumerate(names)})


def split(df: DataFrame, train_percent: int = 80, seed: int = SPLIT_SEED
          ) -> tuple[DataFrame, DataFrame]:
    """Seeded train and test parts, decided by the cohort key alone."""
    part = stable_bucket(COHORT_KEY, seed, 100)
    return df.where(part < train_percent), df.where(part >= train_percent)


def split_three(df: DataFrame, train_percent: int = 70, test_percent: int = 15,
                seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, test and hold-out parts. The hold-out scores models after all choices are made."""
    part = stable_bucket(COHORT_KEY, seed, 100)
    seen = train_percent + test_percent
    return (df.where(part < train_percent), df.where((part >= train_percent) & (part < seen)),
            df.where(part >= seen))


def with_fold(df: DataFrame, folds: int, seed: int = MODEL_SEED) -> DataFrame:
    return df.withColumn("fold", stable_bucket(COHORT_KEY, seed, folds))


def l2_normalized(df: DataFrame, columns: Sequence[str], output: str = "norm_features"
                  ) -> DataFrame:
    """Rows of ``columns`` scaled to unit length."""
    rows = assembler(columns, "_rows").transform(df)
    return Normalizer(inputCol="_rows", outputCol=output, p=2.0).transform(rows).drop("_rows")


PCA_COLUMNS = ("pca_1", "pca_2", "pca_3", "pca_4")


def pca_pipeline(params: CohortParams, k: int = 4) -> Pipeline:
    """Unit-length metric rows reduced to ``k`` components."""
    return Pipeline(stages=[
        assembler(params.metric_columns, "metric_features"),
        Normalizer(inputCol="metric_features", outputCol="norm_features", p=2.0),
        PCA(k=k, inputCol="norm_features", outputCol="pca_features")])


def reduced_features(df: DataFrame, pca: PipelineModel) -> DataFrame:
    """Session averages and the components as the vector ``reduced_features``."""
    rows = vector_columns(pca.transform(df), "pca_features", PCA_COLUMNS)
    return assembler([*SESSION_AVERAGES, *PCA_COLUMNS], "reduced_features").transform(rows)

"""Checks an analyst runs on a table: duplicates, suspicious values, counts, preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from cohortide.params import COHORT_KEY


def duplicate_cohorts(df: DataFrame, key: Sequence[str] = COHORT_KEY) -> DataFrame:
    """Key values that occur more than once, most frequent first."""
    return (df.groupBy(*key).count().where(F.col("count") > 1)
            .orderBy(F.desc("count"), *key))


def _suspicious(field: T.StructField):
    value = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return (value.isNull() | value.contains("None") | value.contains("NULL") | (value == ""))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def _missing(df: DataFrame, skip: Sequence[str]) -> list[Column]:
    return [F.count_if(_suspicious(f)).alias(f.name) for f in df.schema.fields if f.name not in skip]


def dq_profile(df: DataFrame, skip: Sequence[str] = ("first_touch_date",)) -> DataFrame:
    """Per column, how many values are missing in any spelling. One row, one pass."""
    return df.agg(*_missing(df, skip))


class Profiled:
    """Rows whose profile comes with their write: the numbers are gathered in that pass.

    Write ``rows``; ``n_rows`` and ``profile`` then hold what was seen. They wait until it is."""

    def __init__(self, df: DataFrame, skip: Sequence[str] = ("first_touch_date",)):
        self.observation = Observation()
        self.names = [f.name for f in df.schema.fields if f.name not in skip]
        self.spark = df.sparkSession
        self.rows = df.observe(self.observation, F.count(F.lit(1)).alias("_rows"), *_missing(df, skip))

    @property
    def n_rows(self) -> int:
        return self.observation.get["_rows"]

    @property
    def profile(self) -> DataFrame:
        """As ``dq_profile``."""
        got = self.observation.get
        return self.spark.createDataFrame([tuple(got[c] for c in self.names)],
                                          ", ".join(f"`{c}` bigint" for c in self.names))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count()


def preview(df: DataFrame, n: int = 3, order: Sequence[str] = ()) -> DataFrame:
    """A few rows to look at; give ``order`` when the choice of rows matters."""
    return (df.orderBy(*order) if order else df).limit(n)

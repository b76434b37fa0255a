"""Scores of finished fits, kept so that a search can stop and go on, or be shared.

A ledger is a folder of Parquet files with one row for each (study, model, settings, fold). A study
is named by a digest of the rows, the features, the folds and the seed, so fits of other data are
never taken for these. A search reads what is there, fits what is not, and appends the scores of a
batch of fits at a time; what a killed search had appended is not fitted again. A fit that two
searches both appended gives the same score twice and counts once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide.session import shared_folder

SCHEMA = "study string, model string, settings string, fold int, rmse double, rows long"
Trial = tuple[str, int]


def settings_key(settings: Mapping[str, object]) -> str:
    """Settings as text; numbers by value, so that 1 and 1.0 are one."""
    return json.dumps({k: float(v) if isinstance(v, (int, float)) else v
                       for k, v in sorted(settings.items())}, sort_keys=True)


def study_of(rows: DataFrame, *about: object) -> str:
    """A name for what is fitted: order and partitioning of ``rows`` do not change it."""
    columns = sorted(rows.columns)
    body = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")),
                    F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)"))).first()
    text = json.dumps([columns, *map(str, body), *map(str, about)])
    return rows.sparkSession.range(1).select(F.md5(F.lit(text))).first()[0]


class TrialLedger:
    def __init__(self, spark: SparkSession, path: str | None = None):
        """``path`` defaults to one ledger in the shared folder."""
        self.spark = spark
        self.path = path or f"{shared_folder(spark).rstrip('/')}/trial-ledger"
        # An empty file set has no schema to read; an append of no rows makes it exist.
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(self.path)

    def scores(self, study: str, model: str) -> DataFrame:
        """settings, fold, rmse and rows of the finished fits of a study."""
        return (self.spark.read.schema(SCHEMA).parquet(self.path)
                .where((F.col("study") == study) & (F.col("model") == model))
                .groupBy("settings", "fold").agg(F.min("rmse").alias("rmse"), F.min("rows").alias("rows")))

    def finished(self, study: str, model: str) -> set[Trial]:
        """As many as the grid has points times folds, whatever the data's size."""
        return {(r.settings, r.fold) for r in self.scores(study, model).select("settings", "fold").collect()}

    def append(self, study: str, model: str, fits: Iterable[tuple[str, int, float, int]]) -> None:
        """Add (settings, fold, rmse, rows) of finished fits, as one file."""
        rows = [(study, model, *fit) for fit in fits]
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

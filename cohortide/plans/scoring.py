"""Predict cohort lifetime value for one request folder or for any number of requests."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide.functions.columns import name_region
from cohortide.models.prepare import vectors
from cohortide.operators.features import join_features
from cohortide.operators.timeline import is_timeline, store_timeline
from cohortide.params import COHORT_KEY, CohortParams, CohortRequest
from cohortide.plans.cohort_queries import QUERIES, of_requested_users
from cohortide.sources.tables import (read_prediction, read_request_tables, write_prediction,
                                      write_request_table)


def predict(wide: DataFrame, model: Model, params: CohortParams) -> DataFrame:
    """One row: the mean prediction over the given cohorts (NULL when there are none)."""
    return model.transform(vectors(wide, params)).agg(F.avg("prediction").alias("predicted_ltv"))


def score_cohorts(wide: DataFrame, model: Model, params: CohortParams) -> DataFrame:
    return model.transform(vectors(wide, params)).select(*COHORT_KEY, "prediction")


def request_features(requests: DataFrame, wide: DataFrame) -> DataFrame:
    """All requests with the features of the cohort they ask for; unknown cohorts get NULLs."""
    marked = wide.withColumn("known", F.lit(True))
    return requests.join(marked, list(COHORT_KEY), "left").withColumn(
        "known", F.coalesce("known", F.lit(False)))


def score_requests(requests: DataFrame, wide: DataFrame, model: Model, params: CohortParams
                   ) -> DataFrame:
    """``request_id, predicted_ltv`` for every request, NULL where the cohort is unknown.

    Each requested cohort is scored once, however many requests name it.
    """
    asked = wide.join(requests.select(*COHORT_KEY).distinct(), list(COHORT_KEY), "left_semi")
    scored = score_cohorts(asked, model, params)
    return (requests.join(scored, list(COHORT_KEY), "left")
            .groupBy("request_id").agg(F.avg("prediction").alias("predicted_ltv")))


def prepare_request(events: DataFrame, params: CohortParams, request: CohortRequest,
                    root: str, request_id: str) -> None:
    """Run the three queries for one cohort and store their tables in the request's folder.

    ``events`` may be a stored timeline; otherwise one of the requested users is stored first, so
    the log is read once for them and not by each query."""
    source = _scanned_once(of_requested_users(events, params, request), params)
    for job, query in QUERIES.items():
        write_request_table(query(source, params, request), root, request_id, job)


def _scanned_once(events: DataFrame, params: CohortParams) -> DataFrame:
    return events if params.cross_user_gaps or is_timeline(events) \
        else store_timeline(events, params)


def prepare_requests(events: DataFrame, params: CohortParams, requests: DataFrame, root: str
                     ) -> None:
    """The same for any number of requests: each query runs once, and the rows of a cohort are stored
    once, however many requests ask for it, beside a table of which request asks for which cohort."""
    source = _scanned_once(events, params)
    asked = requests.select("request_id", *COHORT_KEY).distinct()
    asked.write.mode("overwrite").parquet(f"{root}/requests")
    cohorts = events.sparkSession.read.schema(asked.schema).parquet(f"{root}/requests").select(
        *COHORT_KEY).distinct()
    for job, query in QUERIES.items():
        rows = query(source, params).join(cohorts, list(COHORT_KEY), "left_semi")
        rows.write.mode("overwrite").parquet(f"{root}/{job}")


def read_prepared(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``requests``, or the stored cohort rows of one of the queries."""
    return spark.read.parquet(f"{root}/{table}")


def prepared_rows(spark: SparkSession, root: str, job: str) -> DataFrame:
    """The rows of a query for every request that asked for them."""
    return read_prepared(spark, root, "requests").join(
        read_prepared(spark, root, job), list(COHORT_KEY))


def prepared_features(spark: SparkSession, root: str, params: CohortParams) -> DataFrame:
    """Features of every prepared request's cohort, as ``request_features``."""
    tables = {job: read_prepared(spark, root, job) for job in QUERIES}
    wide = join_features(tables["ltv"], tables["event"], tables["session"], params)
    asked = read_prepared(spark, root, "requests").withColumn("country", name_region())
    return request_features(asked, wide)


def predict_requests(spark: SparkSession, root: str, model: Model, params: CohortParams) -> DataFrame:
    """``request_id, predicted_ltv`` of all prepared requests. A cohort is scored once; an unknown one
    gives NULL."""
    tables = {job: read_prepared(spark, root, job) for job in QUERIES}
    wide = join_features(tables["ltv"], tables["event"], tables["session"], params)
    asked = read_prepared(spark, root, "requests").withColumn("country", name_region())
    return score_requests(asked, wide, model, params)


def predict_request(spark: SparkSession, root: str, request_id: str, model: Model,
                    params: CohortParams) -> DataFrame:
    """Score a prepared request folder, store the prediction, return the done message's columns."""
    tables = read_request_tables(spark, root, request_id)
    wide = join_features(tables["ltv"], tables["event"], tables["session"], params)
    write_prediction(predict(wide, model, params), root, request_id)
    return read_prediction(spark, root, request_id)

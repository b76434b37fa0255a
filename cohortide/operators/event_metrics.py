"""Engagement metrics per user, session and day, and their day-bucket pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortide.functions.columns import bucket_label
from cohortide.operators.activity import with_launch_day
from cohortide.operators.timeline import USER, user_timeline, with_sessions
from cohortide.params import COHORT_KEY, DIMENSIONS, CohortParams, MetricSpec

DECIMAL = "decimal(38,9)"


def has_dimensions() -> Column:
    known = F.lit(True)
    for name in DIMENSIONS:
        known = known & F.col(name).isNotNull()
    return known


def reported(spec: MetricSpec, params: CohortParams, suffix: str = "") -> Column:
    """The output column of a metric, from the integer sum column ``<metric><suffix>``."""
    source = spec.mirrors if spec.mirrors and not params.corrected_metrics else spec.name
    total = f"{source}{suffix}"
    if spec.how == "milli_sum":
        total = f"CAST(CAST({total} AS {DECIMAL}) / 1000 AS {DECIMAL})"
    return F.expr(f"{total} AS {spec.name}{suffix}")


def event_session_metrics(events: DataFrame, params: CohortParams) -> DataFrame:
    """One row per user, session, day and dimensions that had a counted parameter.

    A metric without any matching parameter is NULL, not 0. A session that crosses midnight
    yields a row per day. Everything after the per-user window stays on the same partitioning.
    """
    sessions = with_sessions(user_timeline(events, params, metrics=True), params)
    sums = [F.expr(f"sum({m.name}) AS {m.name}") for m in params.summed_metrics]
    per_day = (
        sessions.where(has_dimensions())
        .groupBy(USER, "first_touch_date", "activity_day", "user_session_id", *DIMENSIONS)
        .agg(F.sum("matched").alias("matched"), *sums)
        .where(F.col("matched") > 0)
    )
    flags = [f"d_{edge}" for edge in params.day_edges]
    return with_launch_day(per_day, params).select(
        USER, "first_touch_date", "activity_day", "day_after_launch", *flags,
        "user_session_id", *DIMENSIONS,
        *[reported(m, params) for m in params.metrics],
    )


def with_bucket(rows: DataFrame, params: CohortParams) -> DataFrame:
    """Collapse the day number to its bucket name in ``d_cat`` (NULL after the last bucket)."""
    return rows.withColumn("d_cat", bucket_label(F.col("day_after_launch"), params.day_edges))


def bucket_presence(event_rows: DataFrame, params: CohortParams) -> DataFrame:
    """Per cohort, how many event rows fall in each day bucket."""
    return event_rows.groupBy(*COHORT_KEY).agg(
        *[F.sum(flag).alias(flag) for flag in params.buckets])


def missing_buckets(event_rows: DataFrame, params: CohortParams) -> DataFrame:
    """(cohort, ``d_cat``) for every bucket in which a cohort has no event row."""
    absent = F.array_compact(F.array(
        *[F.when(F.col(flag) == 0, F.lit(flag)) for flag in params.buckets]))
    return bucket_presence(event_rows, params).select(
        *COHORT_KEY, F.explode(absent).alias("d_cat"))


def complete_buckets(event_rows: DataFrame, params: CohortParams) -> DataFrame:
    """Event rows with ``d_cat``, plus one row of NULL metrics per missing bucket of a cohort.

    Existing rows are left as they are: only buckets that are really absent are added.
    """
    present = with_bucket(event_rows, params)
    return present.unionByName(missing_buckets(event_rows, params), allowMissingColumns=True)


def event_bucket_pivot(event_rows: DataFrame, params: CohortParams) -> DataFrame:
    """Per cohort, the sum of each metric in each bucket as ``<metric>_<bucket>``.

    The buckets are declared, so the schema never depends on the data, no distinct job runs, and
    one conditional aggregation (one exchange) does what a generic pivot needs two for.
    """
    labelled = with_bucket(event_rows, params)
    return labelled.groupBy(*COHORT_KEY).agg(*[
        F.expr(f"sum({metric}) FILTER (WHERE d_cat = '{bucket}') AS {metric}_{bucket}")
        for bucket in params.buckets for metric in params.metric_names])

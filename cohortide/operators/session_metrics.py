"""Session durations and cohort session averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortide.functions.time import MICROS_PER_SECOND, elapsed_whole
from cohortide.operators.timeline import USER, user_timeline, with_sessions
from cohortide.params import COHORT_KEY, CohortParams


def session_durations(events: DataFrame, params: CohortParams) -> DataFrame:
    """One row per user, session and dimension values: elapsed whole seconds and the session's
    number. A session whose dimensions change yields one row per combination."""
    sessions = with_sessions(user_timeline(events, params), params)
    spans = sessions.groupBy(*COHORT_KEY, USER, "user_session_id").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return spans.select(
        *COHORT_KEY, USER, "user_session_id",
        elapsed_whole(F.col("last_ts") - F.col("first_ts"), MICROS_PER_SECOND)
        .alias("session_duration_sec"),
        F.col("user_session_id").alias("n_sessions"),
    )


def session_cohort_metrics(events: DataFrame, params: CohortParams) -> DataFrame:
    """Cohort averages of session length and session number.

    ``avg_sessions_count`` is the mean session *number* (the feature the models were built on);
    ``avg_sessions_per_user`` is the number of sessions divided by the number of users.
    """
    per_user = session_durations(events, params).groupBy(*COHORT_KEY, USER).agg(
        F.sum("session_duration_sec").alias("seconds"), F.sum("n_sessions").alias("ordinals"),
        F.count(F.lit(1)).alias("rows"))
    return per_user.groupBy(*COHORT_KEY).agg(
        (F.sum("seconds") / F.sum("rows")).alias("avg_session_duration_sec"),
        (F.sum("ordinals") / F.sum("rows")).alias("avg_sessions_count"),
        F.avg("rows").alias("avg_sessions_per_user"),
    )

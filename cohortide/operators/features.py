"""The wide and long cohort feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortide.functions.columns import bucket_label, melt, name_region
from cohortide.functions.time import MICROS_PER_SECOND, day_number, elapsed_whole
from cohortide.operators.event_metrics import event_bucket_pivot, has_dimensions, reported
from cohortide.operators.revenue import dedupe_ltv, dollars, with_earned_seconds
from cohortide.operators.timeline import USER, user_timeline, with_sessions
from cohortide.params import COHORT_KEY, SESSION_AVERAGES, TARGET, CohortParams


def finish_features(wide: DataFrame, params: CohortParams) -> DataFrame:
    """Declared column order, missing numbers as 0, blank country named."""
    ordered = wide.select(*COHORT_KEY, TARGET, *params.feature_columns)
    return ordered.fillna(0).withColumn("country", name_region())


def join_features(ltv: DataFrame, event_rows: DataFrame, sessions: DataFrame,
                  params: CohortParams) -> DataFrame:
    """Wide table from the three derived tables: deduplicated lifetime value, left-joined to the
    bucket pivot and to the session averages.

    All three inputs are one row per cohort by then; the planner broadcasts a side only when its
    measured size is under the session's threshold.
    """
    key = list(COHORT_KEY)
    wide = (dedupe_ltv(ltv)
            .join(event_bucket_pivot(event_rows, params), key, "left")
            .join(sessions.select(*key, *SESSION_AVERAGES), key, "left"))
    return finish_features(wide, params)


def fused_features(events: DataFrame, params: CohortParams) -> DataFrame:
    """The same wide table straight from events: one scan and no join.

    Lifetime value, bucket sums and session averages share the cohort key, and all derive from
    the user timeline. So events are merged per second and then per slot, ordered per user once,
    rolled up per session on the same partitioning, and combined per cohort: four exchanges, each
    of already merged rows. Only cross-user gaps need the three-table form.
    """
    return finish_features(unfilled_features(events, params), params)


def unfilled_features(events: DataFrame, params: CohortParams) -> DataFrame:
    """The fused table before missing numbers are filled, as a data-quality profile wants it."""
    if params.cross_user_gaps:
        raise ValueError("cross-user gaps pool all users; use join_features")
    timeline = user_timeline(events, params, metrics=True, revenue=True)
    rows = with_earned_seconds(with_sessions(timeline, params)).where(has_dimensions())
    day = day_number(F.col("activity_day"), F.col("first_touch_date"))
    young = (day <= params.lifetime_days) & (F.col("timed_rows") > 0)
    rows = rows.withColumns({"d_cat": bucket_label(day, params.day_edges),
                             "young_sec": F.when(young, F.col("earned_sec")),
                             "late_rows": F.when(day > params.lifetime_days, F.col("earn_rows"))})
    columns = [(f"{m.name}_{b}", m.name, b)
               for b in params.buckets for m in params.summed_metrics]
    per_session = rows.groupBy(*COHORT_KEY, USER, "user_session_id").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.sum("earn_rows").alias("earn_rows"), F.sum("young_sec").alias("young_sec"),
        F.sum("late_rows").alias("late_rows"),
        *[F.expr(f"sum({m}) FILTER (WHERE d_cat = '{b}') AS {name}")
          for name, m, b in columns])
    seconds = elapsed_whole(F.col("last_ts") - F.col("first_ts"), MICROS_PER_SECOND)
    totals = per_session.groupBy(*COHORT_KEY).agg(
        F.sum("earn_rows").alias("earn_rows"), F.sum("young_sec").alias("young_sec"),
        F.sum("late_rows").alias("late_rows"),
        F.sum(seconds).alias("seconds"), F.sum("user_session_id").alias("ordinals"),
        F.count(F.lit(1)).alias("sessions"),
        *[F.expr(f"sum({name}) AS {name}") for name, _, _ in columns])
    # A cohort is listed when it has at least one earning row, on whatever day. One that earned
    # nothing in its lifetime but was active later is worth 0, not unknown.
    value = dollars(F.col("young_sec"), params)
    value = F.when(F.col("late_rows") > 0, F.coalesce(value, F.lit(0.0))).otherwise(value)
    return totals.where(F.col("earn_rows") > 0).select(
        *COHORT_KEY, value.alias(TARGET),
        *[reported(m, params, f"_{b}") for b in params.buckets for m in params.metrics],
        (F.col("seconds") / F.col("sessions")).alias("avg_session_duration_sec"),
        (F.col("ordinals") / F.col("sessions")).alias("avg_sessions_count"))


def to_long(wide: DataFrame, params: CohortParams) -> DataFrame:
    """One row per cohort and metric column; fractional engagement seconds are truncated."""
    whole = wide.withColumns({c: F.col(c).cast("bigint") for c in params.engagement_columns})
    values = whole.withColumns({c: F.col(c).cast("double") for c in params.metric_columns})
    return melt(values, [*COHORT_KEY, TARGET, *SESSION_AVERAGES], params.metric_columns,
                "session_metric", "session_metric_value")

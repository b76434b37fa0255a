"""Ad revenue from time spent on earning screens, and the cohort lifetime value.

Each earning row is worth the whole seconds since the previous earning row of the same session
times a fixed rate. Gaps inside one second truncate to zero, so only the first and last instant
of each second matter: events are merged per (user, second, dimensions) by a map-side combined
aggregation before anything is ordered.

Seconds are summed as integers and multiplied by the rate once, so the result does not depend on
the order of additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortide.functions.time import (DAY_MICROS, MICROS_PER_SECOND, day_number, elapsed_whole,
                                      session_slot_width, slot_start, utc_day)
from cohortide.operators.event_metrics import has_dimensions
from cohortide.operators.timeline import (USER, explode_params, session_slots, user_timeline,
                                          with_sessions)
from cohortide.params import COHORT_KEY, DIMENSIONS, TARGET, CohortParams
from cohortide.session import materialize


def with_earned_seconds(sessions: DataFrame) -> DataFrame:
    """Add ``earned_sec`` and ``timed_rows`` to the slots of a timeline cut into sessions.

    A slot earns what lies between its own rows plus the gap to the last earning row of an
    earlier slot of the same session, which goes to the dimensions of the slot's first row.
    ``timed_rows`` counts the earning rows that have a predecessor in their session; a sum over
    no such row is NULL rather than 0.
    """
    none = F.lit(0).cast("bigint")
    same_session = F.col("earned_until") >= F.col("session_start")
    since = elapsed_whole(F.col("earn_first") - F.col("earned_until"), MICROS_PER_SECOND)
    gap = F.when(F.col("earn_leads"), F.when(same_session, since)).otherwise(none)
    return sessions.withColumns({
        "earned_sec": F.coalesce(gap, none) + F.coalesce("inner_sec", none),
        "timed_rows": F.col("earn_rows") - gap.isNull().cast("bigint"),
    }).drop("earn_leads", "earned_until")


def _per_session_seconds(events: DataFrame, params: CohortParams) -> DataFrame:
    timeline = user_timeline(events, params, revenue=True)
    return (with_earned_seconds(with_sessions(timeline, params))
            .where(F.col("earn_rows") > 0)
            .select(USER, *COHORT_KEY, "activity_day", "earned_sec", "timed_rows"))


def _pooled_seconds(events: DataFrame, params: CohortParams) -> DataFrame:
    """Earned seconds when gaps are measured between *all* users that share a session number.

    Session 1 then holds a row of every user, so the ordering is done in two bounded levels:
    seconds inside a (session number, day), at most 86,400 rows, then days inside a session
    number. Within a second only its first row can carry a non-zero gap; the rest just count.
    """
    width = session_slot_width(params.gap_minutes)
    earning = (
        explode_params(events)
        .where(F.col("screen_class").isin(list(params.revenue_screens)))
        .groupBy(USER, *DIMENSIONS,
                 slot_start(F.col("event_timestamp"), MICROS_PER_SECOND).alias("second"))
        .agg(F.min("event_timestamp").alias("earn_first"),
             F.max("event_timestamp").alias("earn_last"),
             F.count(F.lit(1)).alias("earn_rows"))
        .withColumn("slot", slot_start(F.col("second"), width))
    )
    numbers = session_slots(events, params, all_years=True).select(
        F.col(USER).alias("session_user"), F.col("slot").alias("session_slot"),
        "first_touch_date", "user_session_id")
    # Read twice below, with different columns: written once instead of computed twice.
    rows = materialize(earning.join(
        numbers, F.col(USER).eqNullSafe(F.col("session_user"))
        & (F.col("slot") == F.col("session_slot"))).drop("session_user", "session_slot", "slot"),
        "earning")

    order = ["earn_first", USER, *DIMENSIONS]
    heads = rows.groupBy("user_session_id", "second").agg(
        F.min(F.struct(*order, "first_touch_date")).alias("head"),
        F.max("earn_last").alias("earn_last"),
    ).withColumn("day_start", slot_start(F.col("second"), DAY_MICROS))
    inside = Window.partitionBy("user_session_id", "day_start").orderBy("second")
    day_ends = heads.groupBy("user_session_id", "day_start").agg(
        F.max("earn_last").alias("day_end"))
    days = Window.partitionBy("user_session_id").orderBy("day_start")
    day_before = day_ends.select("user_session_id", "day_start",
                                 F.lag("day_end").over(days).alias("earlier_days"))
    timed = (heads.withColumn("same_day", F.lag("earn_last").over(inside))
             .join(day_before, ["user_session_id", "day_start"]))
    gap = elapsed_whole(
        F.col("head.earn_first") - F.coalesce("same_day", "earlier_days"), MICROS_PER_SECOND)
    carried = timed.select(
        *[F.col(f"head.{c}").alias(c) for c in (USER, *DIMENSIONS, "first_touch_date")],
        utc_day(F.col("second")).alias("activity_day"),
        F.coalesce(gap, F.lit(0).cast("bigint")).alias("earned_sec"),
        F.when(gap.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("bigint").alias("timed_rows"))
    counted = rows.select(USER, *DIMENSIONS, "first_touch_date",
                          utc_day(F.col("second")).alias("activity_day"),
                          F.lit(0).cast("bigint").alias("earned_sec"),
                          F.col("earn_rows").alias("timed_rows"))
    return counted.unionByName(carried).where(
        F.year("first_touch_date") == params.install_year)


def earned_seconds(events: DataFrame, params: CohortParams) -> DataFrame:
    """Rows of user, cohort key, day, earned seconds and count of timed rows, ready to be summed."""
    rows = _pooled_seconds if params.cross_user_gaps else _per_session_seconds
    return rows(events, params).where(has_dimensions())


def _seconds() -> Column:
    return F.when(F.sum("timed_rows") > 0, F.sum("earned_sec"))


def dollars(seconds: Column, params: CohortParams) -> Column:
    return seconds.cast("double") * F.lit(params.usd_per_second)


def revenue_daily(events: DataFrame, params: CohortParams) -> DataFrame:
    """Ad revenue per user, dimensions and day, with the launch day and the in-lifetime flag."""
    daily = earned_seconds(events, params).groupBy(USER, *COHORT_KEY, "activity_day").agg(
        _seconds().alias("earned_sec"))
    day = day_number(F.col("activity_day"), F.col("first_touch_date"))
    return daily.select(
        USER, *COHORT_KEY, "activity_day", day.alias("day_after_launch"),
        in_lifetime(day, params).alias("before_avg_lifetime"),
        dollars(F.col("earned_sec"), params).alias("ad_revenue_at_day"))


def in_lifetime(day: Column, params: CohortParams) -> Column:
    return F.when(day <= params.lifetime_days, 1).otherwise(0).cast("bigint")


def cohort_ltv(events: DataFrame, params: CohortParams) -> DataFrame:
    """Lifetime value per cohort, one row for the days inside the average lifetime and, where the
    cohort was active later, one more of value 0."""
    day = day_number(F.col("activity_day"), F.col("first_touch_date"))
    grouped = (
        earned_seconds(events, params)
        .withColumn("before_avg_lifetime", in_lifetime(day, params))
        .groupBy(*COHORT_KEY, "before_avg_lifetime")
        .agg(_seconds().alias("earned_sec"))
    )
    value = F.when(F.col("before_avg_lifetime") == 1, dollars(F.col("earned_sec"), params))
    return grouped.select(*COHORT_KEY, value.otherwise(F.lit(0.0)).alias(TARGET))


def dedupe_ltv(ltv: DataFrame) -> DataFrame:
    """Keep the highest value per cohort. A maximum ignores NULL just as a descending sort puts
    it last, and combines on the map side where a ranking would not."""
    return ltv.groupBy(*COHORT_KEY).agg(F.max(TARGET).alias(TARGET))

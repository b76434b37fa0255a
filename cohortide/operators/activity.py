"""Active days and first-touch dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortide.functions.time import day_number, utc_day
from cohortide.functions.columns import bucket_flag
from cohortide.operators.timeline import USER
from cohortide.params import CohortParams


def active_days(events: DataFrame) -> DataFrame:
    """One row per user and UTC calendar day with at least one event, parameters or not."""
    return events.select(USER, utc_day(F.col("event_timestamp")).alias("activity_day")).distinct()


def first_touch(events: DataFrame) -> DataFrame:
    """First active day per user: a map-side combined minimum, no ordering."""
    return (events.groupBy(USER).agg(F.min("event_timestamp").alias("first_any"))
            .select(USER, utc_day(F.col("first_any")).alias("first_touch_date")))


def with_launch_day(rows: DataFrame, params: CohortParams) -> DataFrame:
    """Days since install and the 0/1 bucket flags, from the two dates already on the row."""
    day = day_number(F.col("activity_day"), F.col("first_touch_date"))
    with_day = rows.withColumn("day_after_launch", day)
    return with_day.withColumns({
        f"d_{edge}": bucket_flag(F.col("day_after_launch"), params.day_edges, edge)
        for edge in params.day_edges
    })


def daily_activity(events: DataFrame, params: CohortParams) -> DataFrame:
    """Active days with the user's first-touch date, launch-day number and bucket flags.

    The first active day is the least of a user's days, so one scan serves both: days are made
    distinct on the map side first, and a user has at most as many rows as days. An unknown user
    keeps its days and gets no first-touch date.
    """
    first = F.min("activity_day").over(Window.partitionBy(USER))
    days = active_days(events).withColumn("first_touch_date", F.when(F.col(USER).isNotNull(), first))
    return with_launch_day(days, params).select(
        USER, "activity_day", "first_touch_date", "day_after_launch", *params.buckets)

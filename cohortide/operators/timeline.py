"""User timelines: events merged into short time slots, then cut into sessions by inactivity.

A session starts at a user's first event and wherever the gap to the previous event reaches
``gap_minutes``. Ordering a user's raw events in one window task would make that task as large as
the busiest user. Instead the work is done in steps that stay bounded whatever the skew:

1. Events are merged per (user, slot, dimensions) by an ordinary aggregation. Spark combines on
   the map side, so a user holding a third of all events leaves each map task as a few rows.
2. The merged rows are ordered per user. A slot is no longer than the gap, so it lies wholly in
   one session, and a user has at most 16 slots a day for the 90-minute gap, times the dimension
   values the user shows.

Revenue needs the order of events inside a slot as well. It is told by whole seconds, so events
are first merged per (user, second, dimensions), ordered within one (user, slot) - at most 5,400
seconds - and only then merged to slots.

Session number, first-touch date and session start all come from one window stage: no self-join
for the first-touch date, and no second pass over the events.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortide.functions.time import (MICROS_PER_SECOND, MINUTE_MICROS, elapsed_whole,
                                      session_slot_width, slot_start, utc_day, year_start_micros)
from cohortide.params import DIMENSIONS, CohortParams, MetricSpec
from cohortide.session import materialize

USER = "user_pseudo_id"
TIMELINE_DAY = "timeline_day"
#: Files of one day of a timeline table: users are dealt to so many.
DAY_FILES = 8
VALUE_FIELDS = {"int": "int_value", "string": "string_value", "double": "double_value"}


def flatten_events(events: DataFrame) -> DataFrame:
    """Lift the nested dimensions to columns and leave the parameter array as it is."""
    return events.select(
        USER, "event_timestamp", "event_name",
        F.col("traffic_source.medium").alias("traffic_source"),
        F.col("device.operating_system").alias("os"),
        F.col("geo.country").alias("country"),
        "event_params",
    )


def explode_params(events: DataFrame, names: Sequence[str] | None = None,
                   keys: Sequence[str] | None = None) -> DataFrame:
    """One row per event parameter; events without parameters vanish.

    The event-name filter is applied below the explode, the key filter right above it.
    """
    flat = flatten_events(events)
    if names is not None:
        flat = flat.where(F.col("event_name").isin(list(names)))
    rows = flat.select(
        USER, "event_timestamp", "event_name", "traffic_source", "os", "country",
        F.explode("event_params").alias("param"),
    ).select(
        USER, "event_timestamp", "event_name", "traffic_source", "os", "country",
        F.col("param.key").alias("event_key"),
        F.col("param.value.string_value").alias("screen_class"),
        F.col("param.value.int_value").alias("event_value"),
        F.col("param.value.double_value").alias("score_value"),
    )
    return rows if keys is None else rows.where(F.col("event_key").isin(list(keys)))


def metric_sum(spec: MetricSpec) -> Column:
    """Sum over the matching parameter rows, NULL when there is none. Millisecond sums stay
    integers here; they become decimal seconds once, at the end."""
    reading = F.col(f"param.value.{VALUE_FIELDS[spec.field]}")
    hit = (F.col("event_name") == spec.event) & (F.col("param.key") == spec.key)
    value = reading if spec.how == "milli_sum" else reading.isNotNull().cast("bigint")
    return F.sum(F.when(hit, value)).alias(spec.name)


def user_timeline(events: DataFrame, params: CohortParams, metrics: bool = False,
                  revenue: bool = False, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Merge events per (user, slot, dimensions).

    Columns: the grouping key, ``first_any`` (earliest event of any kind), ``first_ts`` and
    ``last_ts`` (events that carry parameters, which alone form sessions) and, on request,
    ``matched`` with one column per engagement metric, and for revenue-eligible parameter rows
    ``earn_first``, ``earn_last``, ``earn_rows`` and ``inner_sec`` (seconds between such rows of
    the slot).

    Only parameter rows that some requested column reads survive the explode, plus the first of
    each event, so the aggregation sees about one row per event rather than one per parameter.
    Users installed before the install year are dropped later on, so their earlier events are
    merged into a single row that serves just to disqualify them.

    A timeline given in place of events is returned as it is, so every query can start from a
    stored one. It carries the parameters it was built with; others are refused.
    """
    if is_timeline(events):
        check_timeline(events, params)
        return events
    width = session_slot_width(params.gap_minutes)
    unit = MICROS_PER_SECOND if revenue else width
    flat = flatten_events(events)
    ts = F.col("event_timestamp")
    opens = year_start_micros(params.install_year)
    if params.cross_user_gaps:
        # Gaps are measured across users of any year here, so nothing may be left out.
        live, slot = F.lit(True), slot_start(ts, unit)
    else:
        # No user id means no install date, and such rows never reach a result.
        flat = flat.where(F.col(USER).isNotNull())
        live = ts >= opens
        slot = F.when(live, slot_start(ts, unit)).otherwise(F.lit(opens - width))
    base = [F.col(USER), slot.alias("slot"), ts.alias("event_timestamp"),
            *[F.when(live, F.col(d)).alias(d) for d in dims]]

    if not (metrics or revenue):
        rows = flat.select(*base, (F.coalesce(F.size("event_params"), F.lit(0)) > 0).alias("real"))
    else:
        wanted = (F.col("pos") == 0) | F.col("pos").isNull()
        matched = (F.col("event_name").isin(list(params.event_names))
                   & F.col("param.key").isin(list(params.param_keys)))
        earns = F.col("param.value.string_value").isin(list(params.revenue_screens))
        if metrics:
            wanted = wanted | matched
        if revenue:
            wanted = wanted | earns
        rows = (
            flat.select(*base, "event_name",
                        F.posexplode_outer(F.when(live, F.col("event_params")))
                        .alias("pos", "param"))
            .where(wanted)
            .withColumn("real", F.col("pos").isNotNull())
        )

    when_ts = F.when(F.col("real"), F.col("event_timestamp"))
    aggs = [F.min("event_timestamp").alias("first_any"), F.min(when_ts).alias("first_ts"),
            F.max(when_ts).alias("last_ts")]
    sums = []
    if metrics:
        aggs.append(F.sum(F.when(matched, 1).otherwise(0)).alias("matched"))
        aggs += [metric_sum(m) for m in params.summed_metrics]
        sums += ["matched", *[m.name for m in params.summed_metrics]]
    if not revenue:
        return rows.groupBy(USER, "slot", *dims).agg(*aggs)
    earn_ts = F.when(earns, F.col("event_timestamp"))
    aggs += [F.min(earn_ts).alias("earn_first"), F.max(earn_ts).alias("earn_last"),
             F.count(earn_ts).alias("earn_rows")]
    seconds = rows.groupBy(USER, F.col("slot").alias("second"), *dims).agg(*aggs)
    return merge_seconds(seconds, width, dims, [*sums, "earn_rows"])


def is_timeline(rows: DataFrame) -> bool:
    return "first_any" in rows.columns


def timeline_params(params: CohortParams) -> str:
    """The parameters that decide what a timeline holds, as text."""
    return json.dumps([
        params.install_year, params.gap_minutes, params.cross_user_gaps,
        sorted(params.revenue_screens), sorted(params.event_names), sorted(params.param_keys),
        [[m.name, m.event, m.key, m.field, m.how] for m in params.summed_metrics]])


def check_timeline(timeline: DataFrame, params: CohortParams) -> None:
    """Raise if a stored timeline was built with other parameters. One without a note of them, as
    when it is built by hand, is taken as it is."""
    built = timeline.schema["first_any"].metadata.get("params")
    if built is not None and built != timeline_params(params):
        raise ValueError("the timeline was stored with other parameters")


def full_timeline(events: DataFrame, params: CohortParams) -> DataFrame:
    """The merged timeline with every column and a note of its parameters."""
    rows = user_timeline(events, params, metrics=True, revenue=True)
    return rows.withMetadata("first_any", {"params": timeline_params(params)})


def store_timeline(events: DataFrame, params: CohortParams) -> DataFrame:
    """Scan the log once for all cohort queries: the merged timeline, written to the shared
    folder. Pooled revenue is the one query that still needs the events."""
    return materialize(full_timeline(events, params), "timeline")


def update_timeline(events: DataFrame, params: CohortParams, path: str, days: Sequence[dt.date]) -> None:
    """Build, or rebuild, the parts of a timeline table for some days of the log.

    The table is partitioned by day. Slots nest in a day, so the log of a day decides its part and no
    other; sessions that go on over midnight are joined when the table is queried. A late or corrected
    day is given again and its part is replaced. ``events`` must hold those days whole; others in it
    are left out. A day that has become empty keeps its part: drop that folder instead.
    """
    if params.cross_user_gaps:
        raise ValueError("pooled gaps are measured on events, not on a timeline")
    width, opens = session_slot_width(params.gap_minutes), year_start_micros(params.install_year)
    ts = F.col("event_timestamp")
    own = events.where(utc_day(ts).isin(list(days)))
    live = full_timeline(own.where(ts >= opens), params).withColumn(TIMELINE_DAY, utc_day(F.col("slot")))
    # Of the years before only that a user was there, by day, so that such a day can be replaced too.
    before = (own.where((ts < opens) & F.col(USER).isNotNull())
              .groupBy(USER, utc_day(ts).alias(TIMELINE_DAY)).agg(F.min(ts).alias("first_any"))
              .withColumn("slot", F.lit(opens - width)))
    rows = live.unionByName(before, allowMissingColumns=True).withMetadata(
        "first_any", {"params": timeline_params(params)})
    (rows.repartition(TIMELINE_DAY, F.pmod(F.xxhash64(USER), F.lit(DAY_FILES)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(TIMELINE_DAY).parquet(path))


def read_timeline(spark: SparkSession, path: str, params: CohortParams) -> DataFrame:
    """A timeline table of ``update_timeline``, to be given to any query in place of events."""
    timeline = spark.read.parquet(path).drop(TIMELINE_DAY)
    check_timeline(timeline, params)
    return timeline


def merge_seconds(seconds: DataFrame, width: int, dims: Sequence[str], sums: Sequence[str]
                  ) -> DataFrame:
    """Order the seconds within each (user, slot) and merge them to slots.

    ``inner_sec`` adds up the whole seconds from each earning row to the one before it in the
    slot. Gaps inside one second are 0, so only the earliest row of a second (ties broken by the
    dimensions) can carry one. The slot's very first earning row has none yet; what precedes it
    lies in an earlier slot.
    """
    within = Window.partitionBy(USER, "slot").orderBy("second")
    instant = F.when(F.col("earn_rows") > 0, F.struct("earn_first", *dims))
    ordered = seconds.withColumn("slot", slot_start(F.col("second"), width)).withColumns({
        "leads": instant == F.min(instant).over(within.rangeBetween(0, 0)),
        "earned_until": F.max("earn_last").over(
            within.rangeBetween(Window.unboundedPreceding, -1)),
    })
    gap = elapsed_whole(F.col("earn_first") - F.col("earned_until"), MICROS_PER_SECOND)
    return ordered.groupBy(USER, "slot", *dims).agg(
        F.min("first_any").alias("first_any"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"), F.min("earn_first").alias("earn_first"),
        F.max("earn_last").alias("earn_last"),
        F.sum(F.when(F.col("leads"), gap)).alias("inner_sec"),
        *[F.expr(f"sum({name}) AS {name}") for name in sums])


def per_user_by_slot(lower: int | None = None, upper: int | None = 0):
    """Window over one user's slots; ``None`` is unbounded. Value-based, so rows of the same slot
    are peers and see the same result whatever their physical order."""
    lower = Window.unboundedPreceding if lower is None else lower
    upper = Window.unboundedFollowing if upper is None else upper
    return Window.partitionBy(USER).orderBy("slot").rangeBetween(lower, upper)


def with_sessions(timeline: DataFrame, params: CohortParams, all_years: bool = False) -> DataFrame:
    """Add ``user_session_id``, ``session_start``, ``first_touch_date`` and ``activity_day``.

    A revenue timeline also gets ``earn_leads`` (is this the slot's earliest earning row) and
    ``earned_until`` (last earning instant of the user's earlier slots). All windows share one
    partitioning and ordering, hence one exchange and one sort.
    """
    ordered = Window.partitionBy(USER).orderBy("slot")
    gap = params.gap_minutes * MINUTE_MICROS
    windows = {
        "slot_first": F.min("first_ts").over(per_user_by_slot(0, 0)),
        "seen_until": F.max("last_ts").over(per_user_by_slot(None, -1)),
        "user_first": F.min("first_any").over(per_user_by_slot(None, None)),
        "slot_before": F.lag("slot").over(ordered),
    }
    if "earn_rows" in timeline.columns:
        instant = F.when(F.col("earn_rows") > 0, F.struct("earn_first", *DIMENSIONS))
        windows["earn_leads"] = instant == F.min(instant).over(per_user_by_slot(0, 0))
        windows["earned_until"] = F.max("earn_last").over(per_user_by_slot(None, -1))
    cut = timeline.withColumns(windows)
    fresh = F.col("slot_first").isNotNull() & (
        F.col("seen_until").isNull() | (F.col("slot_first") - F.col("seen_until") >= gap))
    # One of the peers of a slot has another slot before it; only that one counts the session.
    leads = F.col("slot_before").isNull() | (F.col("slot_before") != F.col("slot"))
    upto = per_user_by_slot(None, 0)
    numbered = cut.withColumns({
        "user_session_id":
            F.sum(F.when(fresh & leads, 1).otherwise(0).cast("bigint")).over(upto),
        "session_start": F.max(F.when(fresh, F.col("slot_first"))).over(upto),
        "first_touch_date": F.when(F.col(USER).isNotNull(), utc_day(F.col("user_first"))),
        "activity_day": utc_day(F.col("slot")),
    })
    kept = F.col("first_ts").isNotNull()
    if not all_years:
        kept = kept & (F.year("first_touch_date") == params.install_year)
    return numbered.where(kept).drop(
        "slot_first", "seen_until", "user_first", "slot_before", "first_any")


def session_slots(events: DataFrame, params: CohortParams, all_years: bool = False) -> DataFrame:
    """Session number and first-touch date per (user, slot): the session table other rows join.

    At most one row per user and slot, whatever the events' dimensions.
    """
    timeline = user_timeline(events, params, dims=())
    return with_sessions(timeline, params, all_years).select(
        USER, "slot", "first_touch_date", "user_session_id")


def sessionize(events: DataFrame, params: CohortParams) -> DataFrame:
    """Every event that carries parameters, with its session number and first-touch date.

    Events join the session table on (user, slot), so even a dominant user spreads over its
    slots, and adaptive skew-join splitting covers a slot that is hot by itself.
    """
    width = session_slot_width(params.gap_minutes)
    rows = (flatten_events(events)
            .where(F.col(USER).isNotNull() & (F.size("event_params") > 0)
                   & (F.col("event_timestamp") >= year_start_micros(params.install_year)))
            .withColumn("slot", slot_start(F.col("event_timestamp"), width)))
    return rows.join(session_slots(events, params), [USER, "slot"]).drop("slot")

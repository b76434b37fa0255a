"""What the plans must and must not contain."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from cohortide.operators.event_metrics import event_session_metrics
from cohortide.operators.features import fused_features, join_features
from cohortide.operators.revenue import cohort_ltv, revenue_daily
from cohortide.operators.session_metrics import session_cohort_metrics
from cohortide.operators.timeline import sessionize, user_timeline
from cohortide.params import CohortRequest
from cohortide.plans.cohort_queries import QUERIES as COHORT_QUERIES
from cohortide.sources.events import read_events
from micro import MINUTE, PARAMS, SCREEN, at, event, frame, random_events


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    for day in range(2):
        frame(spark, random_events(day)).write.parquet(f"{path}/events_2018070{day + 1}")
    return read_events(spark, f"{path}/events_*")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


QUERIES = {
    "session": lambda e: session_cohort_metrics(e, PARAMS),
    "event": lambda e: event_session_metrics(e, PARAMS),
    "ltv": lambda e: cohort_ltv(e, PARAMS),
    "fused": lambda e: fused_features(e, PARAMS),
    "pooled": lambda e: revenue_daily(e, PARAMS.but(cross_user_gaps=True)),
    "sessionize": lambda e: sessionize(e, PARAMS),
    "joined": lambda e: join_features(cohort_ltv(e, PARAMS), event_session_metrics(e, PARAMS),
                                      session_cohort_metrics(e, PARAMS), PARAMS),
}


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_join_no_python_and_no_single_partition(stored, name):
    plan = plan_of(QUERIES[name](stored))
    for bad in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEval",
                "SinglePartition"):
        assert bad not in plan


@pytest.mark.parametrize("name, exchanges, scans", [
    ("session", 3, 1), ("event", 2, 1), ("ltv", 4, 1), ("fused", 4, 1)])
def test_one_scan_and_few_exchanges(stored, name, exchanges, scans):
    plan = plan_of(QUERIES[name](stored))
    assert len(re.findall(r"\bExchange ", plan)) == exchanges
    assert len(re.findall(r"FileScan", plan)) == scans
    assert "Join" not in plan


@pytest.mark.parametrize("name", COHORT_QUERIES)
def test_a_requested_cohort_is_filtered_by_user_below_the_windows(stored, name):
    request = CohortRequest(dt.date(2018, 7, 1), os="IOS")
    plan = plan_of(COHORT_QUERIES[name](stored, PARAMS, request))
    assert "LeftSemi" in plan and plan.rindex("Window ") < plan.index("LeftSemi")
    assert len(re.findall(r"FileScan", plan)) == 2


def test_scan_reads_only_what_the_query_needs(stored):
    plan = plan_of(QUERIES["session"](stored))
    schema = re.search(r"ReadSchema: (.*)", plan).group(1)
    assert "event_name" not in schema and "double_value" not in schema
    assert "PushedFilters: [IsNotNull(user_pseudo_id)]" in plan


def test_day_partitions_are_pruned(spark, tmp_path):
    log = [event("u", f"2018-07-0{d} 10:00:00") for d in (1, 2, 3)]
    frame(spark, log).withColumn(
        "event_date", F.timestamp_micros("event_timestamp").cast("date")).write.partitionBy(
        "event_date").parquet(str(tmp_path / "log"))
    some = read_events(spark, str(tmp_path / "log"), since="2018-07-02", until="2018-07-02")
    assert some.count() == 1
    filters = re.search(r"PartitionFilters: (.*?), PushedFilters", plan_of(some)).group(1)
    assert "event_date" in filters


def test_every_shuffle_of_events_is_preceded_by_a_map_side_merge(stored):
    """The first exchange above the scan carries partial aggregates, not raw rows."""
    for name in ("session", "event", "ltv", "fused"):
        plan = plan_of(QUERIES[name](stored))
        below = plan[plan.rindex("Exchange "):]
        assert "partial_" in below.split("FileScan")[0]


def test_a_dominant_user_is_merged_before_it_is_ordered(spark):
    """A third of all events from one user, most of them copies within a few seconds."""
    start = at("2018-07-01 00:00:00")
    log = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("u"), (F.col("id") % 997).cast("string"))).alias("user_pseudo_id"),
        (F.lit(start) + F.when(F.col("id") % 3 == 0, F.col("id") % 5000)
         .otherwise(F.col("id") * MINUTE % (20 * 1440 * MINUTE))).alias("event_timestamp"))
    blank = frame(spark, [event("x", start, params=[SCREEN])]).drop(
        "user_pseudo_id", "event_timestamp").first()
    events = log.select(
        "*", F.lit(blank.event_name).alias("event_name"),
        F.array(F.struct(F.lit("screen").alias("key"), F.struct(
            F.lit("board").alias("string_value"), F.lit(None).cast("bigint").alias("int_value"),
            F.lit(None).cast("double").alias("double_value")).alias("value")))
        .alias("event_params"),
        F.struct(F.lit("cpc").alias("medium")).alias("traffic_source"),
        F.struct(F.lit("IOS").alias("operating_system")).alias("device"),
        F.struct(F.lit("Cyprus").alias("country")).alias("geo"))
    slots = user_timeline(events, PARAMS, revenue=True)
    assert slots.where("user_pseudo_id = 'hot'").count() == 1
    assert slots.agg({"earn_rows": "sum"}).collect()[0][0] == 60000
    assert cohort_ltv(events, PARAMS).count() >= 1

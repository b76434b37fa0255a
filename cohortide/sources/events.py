"""Readers that yield the canonical nested event log."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortide.functions.time import utc_day
from cohortide.params import CohortParams, MetricSpec
from cohortide.session import pin_utc
from cohortide.sources import files
from cohortide.sources.schemas import EVENTS

SHARD_DAY = "shard_day"


def read_events(spark: SparkSession, paths: str | Sequence[str], fmt: str = "parquet",
                since: str | None = None, until: str | None = None,
                day_column: str = "event_date") -> DataFrame:
    """Union of all daily shards that the path globs match, e.g. ``.../events_*``.

    The declared schema names only the nested fields the queries touch, so the scan reads no
    others. ``since`` and ``until`` prune a log partitioned by ``day_column``. Mind that first
    touch needs every earlier day and session averages every later one: prune only days that
    the question leaves out on purpose.
    """
    globs = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.format(fmt).schema(EVENTS).load(globs)
    if since is not None:
        rows = rows.where(F.col(day_column) >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.where(F.col(day_column) <= F.lit(until).cast("date"))
    return rows.select(*EVENTS.fieldNames())


def shard_paths(spark: SparkSession, prefix: str, since: dt.date | None = None,
                until: dt.date | None = None) -> list[str]:
    """Shards ``<prefix>YYYYMMDD`` of the days from ``since`` to ``until``, both included.

    Only the parent folder's entries are looked at; shards outside the range are not listed."""
    parent, _, base = prefix.rpartition("/")
    low, high = (f"{d:%Y%m%d}" if d else None for d in (since, until))
    days = [n[len(base):] for n in files.names(spark, parent)
            if n.startswith(base) and re.fullmatch("[0-9]{8}", n[len(base):])]
    return [f"{prefix}{d}" for d in days if (low is None or d >= low) and (high is None or d <= high)]


def read_day_shards(spark: SparkSession, prefix: str, since: dt.date | None = None,
                    until: dt.date | None = None, fmt: str = "parquet", day_column: str | None = None
                    ) -> DataFrame:
    """Events of the day shards ``<prefix>YYYYMMDD`` in a range of days.

    ``day_column`` adds the shard's day, read from the file's path. As with any pruning, first touch
    needs every earlier day and session averages every later one."""
    paths = shard_paths(spark, prefix, since, until)
    if not paths:
        empty = spark.createDataFrame([], EVENTS)
        return empty.withColumn(day_column, F.lit(None).cast("date")) if day_column else empty
    rows = spark.read.format(fmt).schema(EVENTS).load(paths)
    if day_column is None:
        return rows
    base = re.escape(prefix.rpartition("/")[2])
    day = F.regexp_extract(F.col("_metadata.file_path"), f"/{base}([0-9]{{8}})/", 1)
    return rows.select("*", F.to_date(day, "yyyyMMdd").alias(day_column))


def write_day_shards(events: DataFrame, prefix: str, days: Sequence[dt.date]) -> None:
    """Write the events of each of ``days`` to its shard, replacing it.

    All days are written together beside the shards, in files of the size that adaptive execution aims
    at, however long a day is, and each day's folder then becomes its shard by a rename."""
    spark = events.sparkSession
    parent, _, base = prefix.rpartition("/")
    staged = f"{parent}/.{base}{uuid.uuid4().hex}"
    rows = events.withColumn(SHARD_DAY, utc_day(F.col("event_timestamp"))).where(
        F.col(SHARD_DAY).isin(list(days)))
    rows.hint("rebalance", SHARD_DAY).write.partitionBy(SHARD_DAY).parquet(staged)
    written = set(files.names(spark, staged))
    for day in sorted(set(days)):
        name, shard = f"{SHARD_DAY}={day:%Y-%m-%d}", f"{prefix}{day:%Y%m%d}"
        if name in written:
            files.replace(spark, f"{staged}/{name}", shard)
        else:
            spark.createDataFrame([], events.schema).write.mode("overwrite").parquet(shard)
    files.remove(spark, staged)


# The driver tables have event types and one integer property instead of game events. These
# parameters name what stands in for each metric there.
TABLE_PARAMS = CohortParams(
    install_year=2024,
    revenue_screens=("click", "view", "purchase"),
    event_names=("click", "purchase", "error", "signup", "view"),
    param_keys=("k", "screen", "value"),
    metrics=(
        MetricSpec("session_user_engagement_sec", "view", "k", how="milli_sum"),
        MetricSpec("session_claimed_ad_rewards", "click", "k"),
        MetricSpec("session_challenged_friend", "purchase", "k"),
        MetricSpec("session_was_challenged", "signup", "k"),
        MetricSpec("session_played_levels", "purchase", "value", field="double",
                   mirrors="session_completed_levels"),
        MetricSpec("session_completed_levels", "view", "screen", field="string"),
        MetricSpec("session_retried_levels", "click", "screen", field="string"),
        MetricSpec("session_failed_levels", "error", "screen", field="string"),
        MetricSpec("session_reseted_levels", "signup", "screen", field="string"),
        MetricSpec("session_ended_levels", "purchase", "screen", field="string"),
        MetricSpec("session_used_extra_steps", "error", "k"),
        MetricSpec("session_no_more_extra_steps", "view", "k"),
    ),
)


LOG = "ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
CUSTOMER = ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
            "c_mktsegment string")
NATION = "n_nationkey int, n_name string"


def table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")


def events_from_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The driver's ``events``, ``customer`` and ``nation`` tables as canonical events."""
    pin_utc(spark)
    raw = table(spark, folder, "events", LOG)
    customer = table(spark, folder, "customer", CUSTOMER)
    nation = table(spark, folder, "nation", NATION)
    # One table at a time, so that the planner sees each side's real size: it broadcasts the ones
    # under its threshold and sort-merges (with skew splitting) the rest.
    joined = (raw.join(customer, F.col("user_id") == F.col("c_custkey"), "left")
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    none = F.lit(None)
    k = F.get_json_object("props", "$.k").try_cast("bigint")

    def param(key, text=none, whole=none, real=none):
        value = F.struct(text.cast("string").alias("string_value"),
                         whole.cast("bigint").alias("int_value"),
                         real.cast("double").alias("double_value"))
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    params = F.array(param("k", whole=k), param("value", real=F.col("value")),
                     param("screen", text=F.col("event_type")))
    os = F.when(F.col("user_id") % 2 == 0, "IOS").otherwise("ANDROID")
    return joined.select(
        F.col("user_id").cast("string").alias("user_pseudo_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("event_timestamp"),
        F.col("event_type").alias("event_name"),
        params.alias("event_params"),
        F.struct(F.col("c_mktsegment").alias("medium")).alias("traffic_source"),
        F.struct(os.alias("operating_system")).alias("device"),
        F.struct(F.col("n_name").alias("country")).alias("geo"),
    )


__all__ = ["CUSTOMER", "NATION", "TABLE_PARAMS", "events_from_tables", "read_day_shards",
           "read_events", "shard_paths", "table", "write_day_shards"]

"""Day shards, timeline tables, bucketed tables, profiles on write and SQL text."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from cohortide.operators import quality
from cohortide.operators.activity import daily_activity
from cohortide.operators.features import fused_features, unfilled_features
from cohortide.operators.timeline import read_timeline, store_timeline, update_timeline
from cohortide.params import COHORT_KEY, TARGET
from cohortide.plans import cohort_queries, feature_build, sql
from cohortide.sources.events import read_day_shards, shard_paths, write_day_shards
from micro import PARAMS, at, event, frame, random_events


@pytest.fixture(scope="module")
def events(spark):
    old = [event("veteran", "2017-12-31 23:59:00"), event("veteran", "2018-07-02 10:00:00"),
           event(None, "2018-07-02 10:00:00"), event("owl", "2018-07-02 23:50:00"),
           event("owl", "2018-07-03 00:10:00")]
    return frame(spark, random_events(21, 800) + old).cache()


def text(df):
    return sorted(map(repr, df.collect()))


def days_of(events):
    day = F.timestamp_micros("event_timestamp").cast("date").alias("d")
    return [r.d for r in events.select(day).distinct().orderBy("d").collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shards_outside_the_range_are_not_read(spark, events, tmp_path):
    prefix, days = f"{tmp_path}/events_", days_of(events)
    write_day_shards(events, prefix, days)
    (tmp_path / "events_intraday").mkdir()
    assert text(read_day_shards(spark, prefix)) == text(events)
    some = read_day_shards(spark, prefix, days[1], days[2], day_column="shard")
    assert {f.split("/")[-2] for f in some.inputFiles()} == {f"events_{d:%Y%m%d}" for d in days[1:3]}
    day = F.timestamp_micros("event_timestamp").cast("date")
    assert some.where(F.col("shard") != day).count() == 0
    assert some.count() == events.where(day.isin(days[1:3])).count()
    assert shard_paths(spark, prefix, dt.date(2030, 1, 1)) == []
    none = read_day_shards(spark, prefix, dt.date(2030, 1, 1), day_column="shard")
    assert none.count() == 0 and none.columns[-1] == "shard"
    # A late event: its day is written again.
    late = frame(spark, [event("late", f"{days[1]} 12:00:00")])
    write_day_shards(events.unionByName(late), prefix, [days[1]])
    assert read_day_shards(spark, prefix).count() == events.count() + 1


def test_a_long_day_is_written_by_several_tasks(spark, tmp_path):
    rows = [event(f"u{i}", f"2018-07-{1 + i % 2:02d} 10:{i % 60:02d}:00") for i in range(4000)]
    events, days = frame(spark, rows), [dt.date(2018, 7, d) for d in (1, 2, 3)]
    prefix, setting = f"{tmp_path}/events_", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(setting, "16k")
    try:
        write_day_shards(events.repartition(8), prefix, days)
    finally:
        spark.conf.unset(setting)
    assert text(read_day_shards(spark, prefix)) == text(events)
    assert all(len(list(tmp_path.glob(f"events_2018070{d}/part-*"))) > 1 for d in (1, 2))
    # A day without events has an empty shard, and nothing else stays beside the shards.
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"events_2018070{d}" for d in (1, 2, 3)]
    assert read_day_shards(spark, prefix, days[2]).count() == 0


def test_a_timeline_built_by_day_equals_one_built_at_once(spark, events, tmp_path):
    path, days = str(tmp_path / "timeline"), days_of(events)
    half = events.where(F.col("event_timestamp") % 2 == 0)
    for day in days:  # every day comes with half of its events, and the second one whole afterwards
        update_timeline(half if day in days[1:4] else events, PARAMS, path, [day])
    update_timeline(events, PARAMS, path, days[1:4])
    stored = read_timeline(spark, path, PARAMS)
    for query in cohort_queries.QUERIES.values():
        assert text(query(stored, PARAMS)) == text(query(events, PARAMS))
    assert text(fused_features(stored, PARAMS)) == text(fused_features(events, PARAMS))
    rest = stored.where("user_pseudo_id = 'owl'")
    assert rest.count() == 2  # two slots that one session joins
    with pytest.raises(ValueError):
        update_timeline(events, PARAMS.but(cross_user_gaps=True), path, days)


def test_a_timeline_of_other_parameters_is_refused(spark, events, tmp_path):
    stored = store_timeline(events, PARAMS)
    cohort_queries.session_query(stored, PARAMS.but(lifetime_days=3)).count()  # not part of a timeline
    for other in (PARAMS.but(gap_minutes=30), PARAMS.but(revenue_screens=("menu",)),
                  PARAMS.but(install_year=2017), PARAMS.but(corrected_metrics=True)):
        with pytest.raises(ValueError):
            cohort_queries.session_query(stored, other)
    path = str(tmp_path / "timeline")
    update_timeline(events, PARAMS, path, days_of(events))
    with pytest.raises(ValueError):
        read_timeline(spark, path, PARAMS.but(gap_minutes=60))


def test_bucketed_tables_join_without_a_shuffle(spark, events):
    spark.sql("CREATE DATABASE IF NOT EXISTS in_buckets")
    feature_build.store_cohort_tables(events, PARAMS, "in_buckets", 4)
    wide = feature_build.features_of_tables(spark, "in_buckets", PARAMS)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(feature_build.features_of_tables(spark, "in_buckets", PARAMS))
        assert "SortMergeJoin" in plan and not re.search(r"Exchange", plan)
        assert text(wide) == text(fused_features(events, PARAMS))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_the_profile_comes_with_the_write(spark, events):
    raw = unfilled_features(events, PARAMS).select(*COHORT_KEY, TARGET, *PARAMS.feature_columns)
    filled, profile = feature_build.store_profiled(events, PARAMS)
    assert profile.collect() == quality.dq_profile(raw).collect()
    assert text(filled) == text(fused_features(events, PARAMS))
    seen = quality.Profiled(events.select("event_name"), skip=())
    seen.rows.write.format("noop").mode("overwrite").save()
    assert seen.n_rows == events.count()


def test_ordered_queries_come_in_order(spark, events):
    rows = cohort_queries.event_query(events, PARAMS, ordered=True).collect()
    key = [(r.user_pseudo_id, r.user_session_id) for r in rows]
    assert key == sorted(key) and len(set(key)) > 50
    rows = cohort_queries.ltv_query(events, PARAMS, ordered=True).collect()
    key = [tuple(r[c] for c in COHORT_KEY) for r in rows]
    assert key == sorted(key) and len(set(key)) > 10


def test_daily_activity_scans_once(spark, events, tmp_path):
    events.write.parquet(str(tmp_path / "log"))
    plan = plan_of(daily_activity(spark.read.schema(events.schema).parquet(str(tmp_path / "log")), PARAMS))
    assert len(re.findall("FileScan", plan)) == 1 and "Join" not in plan
    unknown = daily_activity(events, PARAMS).where("user_pseudo_id IS NULL").collect()
    assert {(r.first_touch_date, r.d_1) for r in unknown} == {(None, 0)}


def test_cohorts_are_asked_for_in_sql(spark, events):
    sql.declare(spark, PARAMS)
    assert sql.variables(spark, PARAMS) == PARAMS
    spark.sql("SET VAR gap_minutes = 30")
    short = sql.variables(spark, PARAMS)
    assert short == PARAMS.but(gap_minutes=30)
    sql.register(spark, store_timeline(events, short), short)
    cohort = fused_features(events, PARAMS).where("country <> 'Rest of the World'").first()
    for job, query in cohort_queries.QUERIES.items():
        every = query(events, short)
        assert text(spark.sql(f"SELECT * FROM {job}_data()")) == text(every)
        got = spark.sql(f"SELECT * FROM {job}_data(os_name => :os, day => :day)",
                        args={"os": cohort.os, "day": cohort.first_touch_date})
        want = every.where((F.col("os") == cohort.os) & (F.col("first_touch_date") == cohort.first_touch_date))
        assert text(got) == text(want) and got.count()
        # A value is never read as text of the query.
        assert spark.sql(f"SELECT * FROM {job}_data(source => :s)", args={"s": "x' OR '1' = '1"}).count() == 0
    assert at("2018-07-01 00:00:00") > 0

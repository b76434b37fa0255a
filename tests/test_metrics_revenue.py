import datetime as dt
from decimal import Decimal

import pytest

from cohortide.operators.event_metrics import (complete_buckets, event_bucket_pivot,
                                               event_session_metrics, missing_buckets)
from cohortide.operators.features import (finish_features, fused_features, join_features,
                                          to_long)
from cohortide.operators.quality import dq_profile, duplicate_cohorts
from cohortide.operators.revenue import cohort_ltv, dedupe_ltv, revenue_daily
from cohortide.operators.session_metrics import session_cohort_metrics
from cohortide.params import COHORT_KEY, TARGET
from micro import PARAMS, event, expected_revenue, frame, param, random_events

MSEC = param("msec", whole=1500)
POOLED = PARAMS.but(cross_user_gaps=True)


def test_metric_without_a_match_is_null_and_matches_are_counted(spark):
    log = [event("u", "2018-07-01 10:00:00", "engage", [MSEC, MSEC, param("other", whole=9)]),
           event("u", "2018-07-01 10:01:00", "win", [param("level", text="one")]),
           event("u", "2018-07-01 10:02:00", "win", [param("level", real=2.0)]),
           event("v", "2018-07-01 10:00:00", "engage", [MSEC]),
           event("w", "2018-07-01 10:00:00", "engage", [param("other", whole=9)]),
           event("x", "2018-07-01 10:00:00", "other", [MSEC])]
    df = frame(spark, log)
    rows = {r.user_pseudo_id: r for r in event_session_metrics(df, PARAMS).collect()}
    assert set(rows) == {"u", "v"}
    assert rows["u"].session_user_engagement_sec == Decimal("3.000000000")
    assert (rows["u"].session_played_levels, rows["u"].session_completed_levels) == (1, 1)
    assert rows["v"].session_completed_levels is None
    fixed = event_session_metrics(df, PARAMS.but(corrected_metrics=True))
    assert {r.user_pseudo_id: r.session_played_levels for r in fixed.collect()} == {
        "u": 1, "v": None}


def test_midnight_splits_event_rows_and_null_dimensions_are_dropped(spark):
    log = [event("u", "2018-07-01 23:50:00", "engage", [MSEC]),
           event("u", "2018-07-02 00:10:00", "engage", [MSEC]),
           event("n", "2018-07-02 00:10:00", "engage", [MSEC], source=None)]
    rows = event_session_metrics(frame(spark, log), PARAMS).collect()
    assert sorted((r.activity_day.day, r.user_session_id, r.day_after_launch) for r in rows) == [
        (1, 1, 1), (2, 1, 2)]


def test_bucket_edges_and_pivot(spark):
    log = [event("u", f"2018-07-0{d} 10:00:00", "engage", [param("msec", whole=1000 * 2 ** d)])
           for d in range(1, 9)]
    rows = event_session_metrics(frame(spark, log), PARAMS)
    flags = {r.day_after_launch: (r.d_1, r.d_3, r.d_5, r.d_7) for r in rows.collect()}
    assert [flags[d].index(1) if 1 in flags[d] else None for d in range(1, 9)] == [
        0, 1, 1, 2, 2, 3, 3, None]
    row = event_bucket_pivot(rows, PARAMS).collect()[0]
    got = [int(row[f"session_user_engagement_sec_{b}"]) for b in PARAMS.buckets]
    assert got == [2, 4 + 8, 16 + 32, 64 + 128]


def test_only_missing_buckets_are_added(spark):
    log = [event("u", f"2018-07-0{d} 10:00:00", "engage", [MSEC]) for d in (1, 3)]
    rows = event_session_metrics(frame(spark, log), PARAMS)
    assert sorted(r.d_cat for r in missing_buckets(rows, PARAMS).collect()) == ["d_5", "d_7"]
    done = complete_buckets(rows, PARAMS)
    assert sorted(r.d_cat for r in done.collect()) == ["d_1", "d_3", "d_5", "d_7"]
    kept = done.where("user_pseudo_id is not null").agg({"session_user_engagement_sec": "sum"})
    assert kept.collect()[0][0] == Decimal("3.000000000")


def ltv_log():
    days = ["2018-07-01", "2018-07-12", "2018-07-13"]
    return [event("u", f"{d} 10:0{i}:00") for d in days for i in range(2)]


def test_days_after_the_lifetime_make_a_second_row_of_zero(spark):
    ltv = cohort_ltv(frame(spark, ltv_log()), PARAMS)
    assert sorted(r[TARGET] for r in ltv.collect()) == [0.0, pytest.approx(0.012)]
    assert [r["count"] for r in duplicate_cohorts(ltv).collect()] == [2]
    assert [r[TARGET] for r in dedupe_ltv(ltv).collect()] == [pytest.approx(0.012)]


def test_a_lone_earning_row_has_no_revenue_rather_than_zero(spark):
    df = frame(spark, [event("u", "2018-07-01 10:00:00")])
    assert [r.ad_revenue_at_day for r in revenue_daily(df, PARAMS).collect()] == [None]
    assert [r[TARGET] for r in cohort_ltv(df, PARAMS).collect()] == [None]


def test_gaps_between_users_only_when_pooled(spark):
    log = [event("u", "2018-07-01 10:00:00"), event("v", "2018-07-01 10:00:30"),
           event("u", "2018-07-01 10:01:00")]
    own = {r.user_pseudo_id: r.ad_revenue_at_day
           for r in revenue_daily(frame(spark, log), PARAMS).collect()}
    assert own == {"u": pytest.approx(0.006), "v": None}
    pooled = {r.user_pseudo_id: r.ad_revenue_at_day
              for r in revenue_daily(frame(spark, log), POOLED).collect()}
    assert pooled == {"u": pytest.approx(0.003), "v": pytest.approx(0.003)}


@pytest.mark.parametrize("params", [PARAMS, POOLED], ids=["per-user", "pooled"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_logs_match_a_plain_reading(spark, seed, params):
    log = random_events(seed)
    rows = revenue_daily(frame(spark, log), params).collect()
    got = {(r.user_pseudo_id, r.first_touch_date, r.traffic_source, r.os, r.country,
            r.activity_day): r.ad_revenue_at_day for r in rows}
    want = expected_revenue(log, params)
    assert set(got) == set(want)
    for key, seconds in want.items():
        value = None if seconds is None else pytest.approx(seconds * params.usd_per_second)
        assert got[key] == value


@pytest.mark.parametrize("seed", [4, 5])
def test_fused_features_equal_the_joined_tables(spark, seed):
    df = frame(spark, random_events(seed, 800)).cache()
    fused = fused_features(df, PARAMS)
    joined = join_features(cohort_ltv(df, PARAMS), event_session_metrics(df, PARAMS),
                           session_cohort_metrics(df, PARAMS), PARAMS)
    assert fused.columns == joined.columns == [*COHORT_KEY, TARGET, *PARAMS.feature_columns]
    left, right = sorted(map(repr, fused.collect())), sorted(map(repr, joined.collect()))
    assert left == right and len(left) > 3
    assert "Rest of the World" in {r.country for r in fused.collect()}
    assert all(v is not None for r in fused.collect() for v in r)
    long = to_long(fused, PARAMS)
    assert long.count() == len(left) * len(PARAMS.metric_columns)
    back = (long.groupBy(*COHORT_KEY).pivot("session_metric", list(PARAMS.metric_columns))
            .sum("session_metric_value"))
    want = {tuple(r[c] for c in COHORT_KEY): [int(r[c]) for c in PARAMS.metric_columns]
            for r in fused.collect()}
    assert {tuple(r[c] for c in COHORT_KEY): [int(r[c]) for c in PARAMS.metric_columns]
            for r in back.collect()} == want


def test_profile_is_aware_of_types(spark):
    df = spark.createDataFrame(
        [(dt.date(2018, 1, 1), "None", 1, float("nan")), (None, "", None, 1.0),
         (None, "fine", 2, None)],
        "first_touch_date date, country string, n long, v double")
    assert dq_profile(df).collect()[0].asDict() == {"country": 2, "n": 1, "v": 2}


def test_missing_and_nan_numbers_become_zero_and_text_stays(spark):
    names = [*COHORT_KEY, TARGET, *PARAMS.feature_columns]
    values = ", ".join(
        [f"CAST({'NULL' if i % 2 else chr(39) + 'NaN' + chr(39)} AS DOUBLE) AS {n}"
         for i, n in enumerate([TARGET, *PARAMS.feature_columns])])
    raw = spark.sql(f"SELECT DATE'2018-07-01' AS first_touch_date, CAST(NULL AS STRING) AS "
                    f"traffic_source, 'IOS' AS os, '' AS country, {values}")
    row = finish_features(raw, PARAMS).collect()[0]
    assert row.traffic_source is None and row.country == "Rest of the World"
    assert [row[n] for n in names[4:]] == [0.0] * (len(names) - 4)

import datetime as dt

import pytest

from cohortide.operators.activity import active_days, daily_activity, first_touch
from cohortide.operators.session_metrics import session_cohort_metrics, session_durations
from cohortide.operators.timeline import explode_params, sessionize
from micro import (MINUTE, PARAMS, SCREEN, at, event, expected_durations, frame, param,
                   random_events, session_rows)


def numbers(spark, events, params=PARAMS):
    rows = sessionize(frame(spark, events), params).collect()
    return sorted((r.user_pseudo_id, r.event_timestamp, r.user_session_id) for r in rows)


def test_gap_is_closed_at_exactly_ninety_minutes(spark):
    start = at("2018-07-01 00:00:00")
    times = [start, start + 90 * MINUTE - 1]
    times.append(times[-1] + 90 * MINUTE)
    times.append(times[-1] + 90 * MINUTE + 1_000_000)
    got = numbers(spark, [event("u", t) for t in times])
    assert [n for _, _, n in got] == [1, 1, 2, 3]


def test_all_parameters_of_an_event_share_its_session(spark):
    log = [event("u", "2018-07-01 10:00:00", params=[SCREEN, SCREEN, param("x")])]
    assert explode_params(frame(spark, log)).count() == 3
    assert [n for _, _, n in numbers(spark, log)] == [1]


def test_event_without_parameters_counts_for_first_touch_only(spark):
    log = [event("u", "2018-07-01 10:00:00", params=[]), event("u", "2018-07-03 10:00:00"),
           event("u", "2018-07-03 11:00:00")]
    assert numbers(spark, log) == [("u", at("2018-07-03 10:00:00"), 1),
                                   ("u", at("2018-07-03 11:00:00"), 1)]
    row = session_durations(frame(spark, log), PARAMS).collect()[0]
    assert row.first_touch_date == dt.date(2018, 7, 1) and row.session_duration_sec == 3600


def test_session_over_midnight_is_one(spark):
    log = [event("u", "2018-07-01 23:50:00"), event("u", "2018-07-02 00:10:00")]
    rows = session_durations(frame(spark, log), PARAMS).collect()
    assert [(r.user_session_id, r.session_duration_sec) for r in rows] == [(1, 1200)]


def test_changing_dimensions_split_the_group_not_the_session(spark):
    log = [event("u", "2018-07-01 10:00:00", os="IOS"),
           event("u", "2018-07-01 10:05:00", os="ANDROID"),
           event("u", "2018-07-01 10:06:00", os="ANDROID")]
    rows = session_durations(frame(spark, log), PARAMS).collect()
    assert sorted((r.os, r.user_session_id, r.session_duration_sec) for r in rows) == [
        ("ANDROID", 1, 60), ("IOS", 1, 0)]


def test_only_the_install_year_is_kept(spark):
    log = [event("old", "2017-12-31 23:59:59"), event("old", "2018-01-01 00:10:00"),
           event("new", "2018-01-01 00:00:00"), event("late", "2019-01-01 00:00:00")]
    assert {u for u, _, _ in numbers(spark, log)} == {"new"}


def test_averages(spark):
    log = [event("u", "2018-07-01 10:00:00"), event("u", "2018-07-01 10:01:00"),
           event("u", "2018-07-01 15:00:00"), event("v", "2018-07-01 15:00:00")]
    row = session_cohort_metrics(frame(spark, log), PARAMS).collect()[0]
    assert row.avg_session_duration_sec == pytest.approx(20.0)
    assert row.avg_sessions_count == pytest.approx((1 + 2 + 1) / 3)
    assert row.avg_sessions_per_user == pytest.approx(1.5)


@pytest.mark.parametrize("gap", [90, 100, 7])
def test_random_logs_match_a_plain_reading(spark, gap):
    log, params = random_events(gap), PARAMS.but(gap_minutes=gap)
    rows = session_durations(frame(spark, log), params).collect()
    got = {(r.first_touch_date, r.traffic_source, r.os, r.country, r.user_pseudo_id,
            r.user_session_id): r.session_duration_sec for r in rows}
    assert got == expected_durations(log, params)
    keep = {k[4] for k in got}
    want = sorted((u, ts, n) for u, ts, *_, n in session_rows(log, params) if u in keep)
    assert numbers(spark, log, params) == want
    steps = {}
    for user, _, n in want:
        steps.setdefault(user, []).append(n)
    for ids in steps.values():
        assert ids[0] == 1 and all(b - a in (0, 1) for a, b in zip(ids, ids[1:]))


def test_result_does_not_depend_on_partitioning(spark):
    df = frame(spark, random_events(5))
    one = session_durations(df.coalesce(1), PARAMS).collect()
    many = session_durations(df.repartition(13), PARAMS).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_activity(spark):
    log = [event("u", "2018-07-01 10:00:00"), event("u", "2018-07-01 11:00:00"),
           event("u", "2018-07-04 11:00:00", params=[]), event(None, "2018-07-02 00:00:00")]
    df = frame(spark, log)
    assert active_days(df).count() == 3
    touched = {r.user_pseudo_id: r.first_touch_date for r in first_touch(df).collect()}
    assert touched["u"] == dt.date(2018, 7, 1)
    days = {(r.user_pseudo_id, r.day_after_launch): (r.d_1, r.d_3, r.d_5, r.d_7)
            for r in daily_activity(df, PARAMS).collect()}
    assert days[("u", 1)] == (1, 0, 0, 0) and days[("u", 4)] == (0, 0, 1, 0)
    assert days[(None, None)] == (0, 0, 0, 0)

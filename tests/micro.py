"""Hand-made event logs and a plain Python reading of the queries to check Spark against."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

from cohortide.params import CohortParams, MetricSpec
from cohortide.sources.schemas import EVENTS

EPOCH = dt.datetime(1970, 1, 1)
SECOND = 1_000_000
MINUTE = 60 * SECOND

PARAMS = CohortParams(
    install_year=2018, revenue_screens=("board", "menu"), event_names=("engage", "win"),
    param_keys=("msec", "level"),
    metrics=(
        MetricSpec("session_user_engagement_sec", "engage", "msec", how="milli_sum"),
        MetricSpec("session_played_levels", "win", "level", field="double",
                   mirrors="session_completed_levels"),
        MetricSpec("session_completed_levels", "win", "level", field="string"),
    ))


def at(text: str) -> int:
    """Microseconds of a UTC time such as ``2018-07-01 10:00:00``."""
    moment = dt.datetime.fromisoformat(text)
    return int((moment - EPOCH) / dt.timedelta(microseconds=1))


def param(key, text=None, whole=None, real=None):
    return (key, (text, whole, real))


SCREEN = param("screen", text="board")


def event(user, ts, name="screen_view", params=(SCREEN,), source="cpc", os="IOS",
          country="Cyprus"):
    ts = at(ts) if isinstance(ts, str) else ts
    return (user, ts, name, list(params), (source,), (os,), (country,))


def frame(spark, events):
    return spark.createDataFrame(events, EVENTS).repartition(3)


def day_of(ts):
    return (EPOCH + dt.timedelta(microseconds=ts)).date()


def first_days(events):
    out = {}
    for user, ts, *_ in events:
        out[user] = min(out.get(user, day_of(ts)), day_of(ts))
    return {u: (None if u is None else d) for u, d in out.items()}


def nulls_first(values):
    return tuple((v is not None, v if v is not None else "") for v in values)


def session_rows(events, params=PARAMS):
    """(user, ts, dims, params, name, session number) of every event that carries parameters."""
    by_user = defaultdict(list)
    for user, ts, name, ps, (source,), (os,), (country,) in events:
        if ps:
            by_user[user].append((ts, (source, os, country), name, ps))
    out = []
    for user, rows in by_user.items():
        rows.sort(key=lambda r: (r[0], nulls_first(r[1])))
        number, before = 0, None
        for ts, dims, name, ps in rows:
            if before is None or (ts - before) // MINUTE >= params.gap_minutes:
                number += 1
            before = ts
            out.append((user, ts, dims, name, ps, number))
    return out


def expected_durations(events, params=PARAMS):
    first = first_days(events)
    spans = defaultdict(list)
    for user, ts, dims, _, _, number in session_rows(events, params):
        if first[user] is not None and first[user].year == params.install_year:
            spans[(first[user], *dims, user, number)].append(ts)
    return {k: (max(v) - min(v)) // SECOND for k, v in spans.items()}


def expected_revenue(events, params=PARAMS):
    """(user, first day, dims, day) -> summed seconds, None when no row has a predecessor."""
    first = first_days(events)
    groups = defaultdict(list)
    for user, ts, dims, _, ps, number in session_rows(events, params):
        for _key, (text, _w, _r) in ps:
            if text in params.revenue_screens:
                key = number if params.cross_user_gaps else (user, number)
                groups[key].append((ts, user, dims))
    daily = defaultdict(list)
    for rows in groups.values():
        rows.sort(key=lambda r: (r[0], nulls_first((r[1], *r[2]))))
        before = None
        for ts, user, dims in rows:
            if first[user] is not None and first[user].year == params.install_year \
                    and None not in dims:
                gap = None if before is None else (ts - before) // SECOND
                daily[(user, first[user], *dims, day_of(ts))].append(gap)
            before = ts
    return {k: (sum(g for g in v if g is not None) if any(g is not None for g in v) else None)
            for k, v in daily.items()}


def random_events(seed: int, n: int = 600):
    """A skewed log: one user has a third of the events, some in the very same second."""
    rng = random.Random(seed)
    start = at("2018-06-28 00:00:00")
    out = []
    for _ in range(n):
        hot = rng.random() < 0.34
        user = "hot" if hot else rng.choice(["a", "b", "c", "d", "e", None])
        ts = start + rng.randrange(16 * 24 * 60) * MINUTE
        if rng.random() < 0.5:
            ts = start + rng.randrange(4) * 1440 * MINUTE + rng.randrange(4 * SECOND)
        if user == "e" and rng.random() < 0.1:
            ts -= 365 * 1440 * MINUTE
        params = []
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            params.append(rng.choice([
                param("screen", text="board"), param("screen", text="menu"),
                param("screen", text="other"), param("msec", whole=rng.randrange(5000)),
                param("msec"), param("level", text="one"), param("level", real=1.5)]))
        out.append(event(user, ts, rng.choice(["engage", "win", "other"]), params,
                         source=rng.choice(["cpc", "cpc", "organic", None]),
                         os=rng.choice(["IOS", "ANDROID"]),
                         country=rng.choice(["Cyprus", "", "Malta"])))
    return out

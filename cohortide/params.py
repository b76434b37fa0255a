"""Everything a query can be parameterised with, as plain frozen dataclasses.

The parameters stay data all the way into the plan (literals and ``isin`` lists); no query text
is ever assembled from them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

COHORT_KEY = ("first_touch_date", "traffic_source", "os", "country")
DIMENSIONS = ("traffic_source", "os", "country")
TARGET = "cohort_ltv_avg_lifetime"
SESSION_AVERAGES = ("avg_session_duration_sec", "avg_sessions_count")


@dataclass(frozen=True)
class MetricSpec:
    """One per-session engagement metric: which event, which parameter, which reading of it.

    ``field`` is the parameter's typed slot (``int``, ``string`` or ``double``). ``how`` is
    ``count`` (non-null readings) or ``milli_sum`` (sum of an int reading, divided by 1000).
    ``mirrors`` names another metric reported in this one's place unless corrected metrics are
    asked for.
    """

    name: str
    event: str
    key: str
    field: str = "int"
    how: str = "count"
    mirrors: str | None = None


# Metric names, event names, parameter keys and screens define the output schema
# and decide which events count.
GAME_METRICS = (
    MetricSpec("session_user_engagement_sec", "user_engagement", "engagement_time_msec",
               how="milli_sum"),
    MetricSpec("session_claimed_ad_rewards", "ad_reward", "value"),
    MetricSpec("session_challenged_friend", "challenge_a_friend", "firebase_screen_id"),
    MetricSpec("session_was_challenged", "challenge_accepted", "firebase_screen_id"),
    MetricSpec("session_played_levels", "post_score", "level_name", field="double",
               mirrors="session_completed_levels"),
    MetricSpec("session_completed_levels", "level_complete", "level_name", field="string"),
    MetricSpec("session_retried_levels", "level_retry", "level_name", field="string"),
    MetricSpec("session_failed_levels", "level_fail", "level_name", field="string"),
    MetricSpec("session_reseted_levels", "level_reset", "level_name", field="string"),
    MetricSpec("session_ended_levels", "level_end", "level_name", field="string"),
    MetricSpec("session_used_extra_steps", "use_extra_steps", "value"),
    MetricSpec("session_no_more_extra_steps", "no_more_extra_steps", "value"),
)

GAME_EVENTS = (
    "user_engagement", "ad_reward", "challenge_a_friend", "challenge_accepted",
    "spend_virtual_currency", "post_score", "level_complete", "level_retry", "level_fail",
    "level_reset", "level_end", "use_extra_steps", "no_more_extra_steps",
)

GAME_KEYS = ("engagement_time_msec", "value", "firebase_screen_id", "level_name")

REVENUE_SCREENS = (
    "game_board", "main_menu", "FIRootViewController", "game_over", "shop_menu",
    "level_select", "GADOInterstitialViewController", "AdActivity", "stats",
    "GADNFullScreenAdViewController",
)


@dataclass(frozen=True)
class CohortParams:
    """Parameters shared by the session, event and lifetime-value queries."""

    install_year: int = 2018
    gap_minutes: int = 90
    day_edges: tuple[int, ...] = (1, 3, 5, 7)
    lifetime_days: int = 12
    usd_per_second: float = 0.0001
    revenue_screens: tuple[str, ...] = REVENUE_SCREENS
    event_names: tuple[str, ...] = GAME_EVENTS
    param_keys: tuple[str, ...] = GAME_KEYS
    metrics: tuple[MetricSpec, ...] = GAME_METRICS
    corrected_metrics: bool = False
    cross_user_gaps: bool = False

    def but(self, **changes) -> "CohortParams":
        return replace(self, **changes)

    @property
    def buckets(self) -> tuple[str, ...]:
        return tuple(f"d_{edge}" for edge in self.day_edges)

    @property
    def metric_names(self) -> tuple[str, ...]:
        return tuple(m.name for m in self.metrics)

    @property
    def summed_metrics(self) -> tuple[MetricSpec, ...]:
        """Metrics that need their own running sum (a mirrored one borrows another's)."""
        return tuple(m for m in self.metrics if self.corrected_metrics or not m.mirrors)

    @property
    def engagement_columns(self) -> tuple[str, ...]:
        """Wide columns holding fractional seconds; the long table stores them truncated."""
        return tuple(f"{m.name}_{b}" for b in self.buckets
                     for m in self.metrics if m.how == "milli_sum")

    @property
    def metric_columns(self) -> tuple[str, ...]:
        return tuple(f"{m}_{b}" for b in self.buckets for m in self.metric_names)

    @property
    def feature_columns(self) -> tuple[str, ...]:
        """Declared, ordered feature list. Models are positional, so this order is the contract
        between training and scoring."""
        return self.metric_columns + SESSION_AVERAGES


@dataclass(frozen=True)
class CohortRequest:
    """A cohort asked for by value. ``None`` leaves that part of the key open."""

    date: dt.date | None = None
    traffic_source: str | None = None
    os: str | None = None
    country: str | None = None

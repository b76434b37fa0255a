"""The three cohort queries, for all cohorts or for one requested cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortide.functions.columns import cohort_predicate
from cohortide.operators.activity import first_touch
from cohortide.operators.event_metrics import event_session_metrics
from cohortide.operators.revenue import cohort_ltv
from cohortide.operators.session_metrics import session_cohort_metrics
from cohortide.operators.timeline import USER, is_timeline
from cohortide.params import COHORT_KEY, CohortParams, CohortRequest


def of_requested_users(events: DataFrame, params: CohortParams, request: CohortRequest
                       ) -> DataFrame:
    """Events of the users first seen on the requested date, so that other users never reach the
    per-user shuffle. Costs one scan of two columns.

    Source, os and country may differ from event to event and stay with the query's own filter.
    Pooled gaps are measured between all users, and a stored timeline is merged already: both are
    returned as they are.
    """
    if request.date is None or params.cross_user_gaps or is_timeline(events):
        return events
    users = first_touch(events).where(F.col("first_touch_date") == F.lit(request.date))
    return events.join(users.select(USER), USER, "left_semi")


def session_query(events: DataFrame, params: CohortParams,
                  request: CohortRequest = CohortRequest()) -> DataFrame:
    rows = session_cohort_metrics(of_requested_users(events, params, request), params)
    return rows.where(cohort_predicate(request))


def event_query(events: DataFrame, params: CohortParams,
                request: CohortRequest = CohortRequest(), ordered: bool = False) -> DataFrame:
    """``ordered`` sorts by user and session, for presentation only."""
    rows = event_session_metrics(of_requested_users(events, params, request), params).where(
        cohort_predicate(request))
    return rows.orderBy("user_pseudo_id", "user_session_id") if ordered else rows


def ltv_query(events: DataFrame, params: CohortParams,
              request: CohortRequest = CohortRequest(), ordered: bool = False) -> DataFrame:
    """``ordered`` sorts by the cohort key, for presentation only."""
    rows = cohort_ltv(of_requested_users(events, params, request), params).where(
        cohort_predicate(request))
    return rows.orderBy(*COHORT_KEY) if ordered else rows


QUERIES = {"session": session_query, "event": event_query, "ltv": ltv_query}

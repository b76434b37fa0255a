"""From events to the stored feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortide.operators.features import (finish_features, fused_features, join_features, to_long,
                                          unfilled_features)
from cohortide.operators.quality import Profiled
from cohortide.operators.timeline import is_timeline, store_timeline
from cohortide.params import COHORT_KEY, TARGET, CohortParams
from cohortide.plans.cohort_queries import QUERIES, event_query, ltv_query, session_query
from cohortide.session import materialize
from cohortide.sources.tables import write_bucketed, write_table


def wide_features(events: DataFrame, params: CohortParams) -> DataFrame:
    """The wide table by the cheapest form the parameters allow."""
    return joined_features(events, params) if params.cross_user_gaps else fused_features(events, params)


def joined_features(events: DataFrame, params: CohortParams) -> DataFrame:
    """The wide table from the three queries, joined. The log is scanned once, for a stored timeline;
    pooled gaps are measured on the events themselves, which takes a second scan."""
    timeline = events if is_timeline(events) else store_timeline(events, params)
    earned = events if params.cross_user_gaps else timeline
    return join_features(ltv_query(earned, params), event_query(timeline, params),
                         session_query(timeline, params), params)


def store_profiled(events: DataFrame, params: CohortParams) -> tuple[DataFrame, DataFrame]:
    """The wide table and the profile of its numbers before they were filled, from one scan.

    What is written are the unfilled rows; the profile is observed while they are, and the filled
    table reads them."""
    if params.cross_user_gaps:
        raise ValueError("pooled gaps need the three-table form")
    seen = Profiled(unfilled_features(events, params).select(*COHORT_KEY, TARGET, *params.feature_columns))
    stored = materialize(seen.rows, "unfilled")
    return finish_features(stored, params), seen.profile


def store_cohort_tables(events: DataFrame, params: CohortParams, namespace: str, buckets: int = 32,
                        **options) -> None:
    """The three derived tables, dealt to buckets by the cohort key, from one scan of the log."""
    source = events if params.cross_user_gaps or is_timeline(events) else store_timeline(events, params)
    for name, query in QUERIES.items():
        write_bucketed(query(source, params), f"{namespace}.{name}_data", COHORT_KEY, buckets, options=options)


def features_of_tables(spark: SparkSession, namespace: str, params: CohortParams) -> DataFrame:
    """The wide table from the three stored ones. Their buckets stand in for every shuffle."""
    tables = {name: spark.table(f"{namespace}.{name}_data") for name in QUERIES}
    return join_features(tables["ltv"], tables["event"], tables["session"], params)


# Names of the two feature tables.
WIDE_TABLE, LONG_TABLE = "processed_data", "processed_data_long"


def store_features(events: DataFrame, params: CohortParams, wide_name: str = WIDE_TABLE,
                   long_name: str = LONG_TABLE, **table_options) -> DataFrame:
    """Compute the wide table once, save it and its long form, and return it."""
    wide = materialize(wide_features(events, params), "features")
    write_table(wide, wide_name, **table_options)
    write_table(to_long(wide, params), long_name, **table_options)
    return wide

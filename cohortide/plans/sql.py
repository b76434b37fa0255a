"""The cohort queries as SQL text: named arguments, table functions and session variables.

``register`` makes the three queries callable from any SQL text of the session:

    SELECT * FROM ltv_data(day => DATE'2018-07-01', os_name => 'IOS')

Values stay data: they come as arguments, as parameter markers (``spark.sql(text, args=...)``) or as
session variables, and no text is ever put together from them. The parameters of the queries are
variables as well: ``declare`` makes them, ``SET VAR gap_minutes = 30`` changes them, and ``variables``
reads them back for ``register``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortide.params import CohortParams
from cohortide.plans.cohort_queries import QUERIES

#: Variables and their types; the names are those of ``CohortParams``.
VARIABLES = {
    "install_year": "INT", "gap_minutes": "INT", "day_edges": "ARRAY<INT>", "lifetime_days": "INT",
    "usd_per_second": "DOUBLE", "revenue_screens": "ARRAY<STRING>", "event_names": "ARRAY<STRING>",
    "param_keys": "ARRAY<STRING>", "corrected_metrics": "BOOLEAN", "cross_user_gaps": "BOOLEAN",
}
#: Arguments of the table functions and the columns they ask for. NULL leaves a column open.
ARGUMENTS = {"day": ("DATE", "first_touch_date"), "source": ("STRING", "traffic_source"),
             "os_name": ("STRING", "os"), "country_name": ("STRING", "country")}


def declare(spark: SparkSession, params: CohortParams) -> None:
    """Session variables with the values of ``params``; existing ones are replaced."""
    for name, kind in VARIABLES.items():
        value = getattr(params, name)
        value = list(value) if isinstance(value, tuple) else value
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind}")
        spark.sql(f"SET VAR {name} = CAST(:value AS {kind})", args={"value": value})


def variables(spark: SparkSession, params: CohortParams) -> CohortParams:
    """``params`` with what the session's variables say now. Metrics are not variables."""
    row = spark.sql(f"SELECT {', '.join(f'session.{name} AS {name}' for name in VARIABLES)}").first()
    return params.but(**{name: tuple(row[name]) if isinstance(row[name], list) else row[name]
                         for name in VARIABLES})


def register(spark: SparkSession, events: DataFrame, params: CohortParams) -> None:
    """Views ``session_rows``, ``event_rows`` and ``ltv_rows`` of all cohorts, and over them the table
    functions ``session_data``, ``event_data`` and ``ltv_data`` of the cohorts asked for.

    ``events`` may be a stored timeline, so that all calls share one scan of the log."""
    for job, query in QUERIES.items():
        rows = query(events, params)
        rows.createOrReplaceTempView(f"{job}_rows")
        given = ", ".join(f"{a} {kind} DEFAULT NULL" for a, (kind, _) in ARGUMENTS.items())
        wanted = " AND ".join(f"({job}_data.{a} IS NULL OR {column} = {job}_data.{a})"
                              for a, (_, column) in ARGUMENTS.items())
        columns = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {job}_data({given}) RETURNS TABLE ({columns}) "
                  f"RETURN SELECT * FROM {job}_rows WHERE {wanted}")

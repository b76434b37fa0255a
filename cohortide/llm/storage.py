"""Written intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortide import session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """As the library's, and the shuffle files behind the table are deleted once it is written.

    Left alone, they stay until the driver happens to collect garbage, and several steps that each
    shuffle about as much as the input add up."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return session.materialize(df, label)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)

"""Column expressions and small DataFrame transforms shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortide.params import CohortRequest

# Fixed value: the name of the blank country.
REST_OF_WORLD = "Rest of the World"


def bucket_flag(day_after_launch: Column, edges: Sequence[int], edge: int) -> Column:
    """1 when the day falls in the bucket that ends at ``edge``, else 0."""
    at = list(edges).index(edge)
    inside = day_after_launch <= edge
    if at > 0:
        inside = inside & (day_after_launch > edges[at - 1])
    return F.when(inside, 1).otherwise(0).cast("bigint")


def bucket_label(day_after_launch: Column, edges: Sequence[int]) -> Column:
    """``d_<edge>`` of the bucket a day falls in, NULL after the last one."""
    label = F.when(day_after_launch <= edges[0], f"d_{edges[0]}")
    for edge in edges[1:]:
        label = label.when(day_after_launch <= edge, f"d_{edge}")
    return label


def cohort_predicate(request: CohortRequest) -> Column:
    """Equality on the parts of the cohort key that the request fixes."""
    wanted = {
        "first_touch_date": request.date, "traffic_source": request.traffic_source,
        "os": request.os, "country": request.country,
    }
    predicate = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            predicate = predicate & (F.col(name) == F.lit(value))
    return predicate


def name_region(country: str = "country") -> Column:
    """Give the blank country a readable name."""
    return F.when(F.col(country) == "", REST_OF_WORLD).otherwise(F.col(country)).alias(country)


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str],
         var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide to long. Values of mixed numeric type widen to their common type."""
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def stable_bucket(columns: Sequence[str], seed: int, buckets: int) -> Column:
    """Bucket 0..buckets-1 from the values alone, so a split or a fold is the same under any
    partitioning, on any retry, and in any engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets)).cast("int")

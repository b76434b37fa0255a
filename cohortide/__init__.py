"""Cohort lifetime-value analytics expressed as Spark DataFrame, ML and streaming jobs."""

from cohortide.params import COHORT_KEY, TARGET, CohortParams, CohortRequest, MetricSpec

__all__ = ["COHORT_KEY", "TARGET", "CohortParams", "CohortRequest", "MetricSpec"]

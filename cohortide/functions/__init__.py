from cohortide.functions.time import (DAY_MICROS, MICROS_PER_SECOND, day_number, elapsed_whole,
                                      slot_start, utc_day, year_start_micros)
from cohortide.functions.columns import (bucket_flag, bucket_label, cohort_predicate, melt,
                                         name_region, stable_bucket)

__all__ = ["DAY_MICROS", "MICROS_PER_SECOND", "day_number", "elapsed_whole", "slot_start",
           "utc_day", "year_start_micros", "bucket_flag", "bucket_label", "cohort_predicate",
           "melt", "name_region", "stable_bucket"]

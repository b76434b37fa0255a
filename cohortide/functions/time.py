"""Time arithmetic on event time kept as microseconds since the epoch.

Working on the integer keeps every result independent of the session time zone, and whole-unit
differences truncate exactly as elapsed time does.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

MICROS_PER_SECOND = 1_000_000
MINUTE_MICROS = 60 * MICROS_PER_SECOND
DAY_MICROS = 24 * 60 * MINUTE_MICROS


def slot_start(micros: Column, width: int) -> Column:
    """Start of the epoch-aligned slot of ``width`` microseconds that holds the instant."""
    return micros - F.pmod(micros, F.lit(width))


def utc_day(micros: Column) -> Column:
    return F.date_from_unix_date((slot_start(micros, DAY_MICROS) / F.lit(DAY_MICROS)).cast("int"))


def elapsed_whole(delta_micros: Column, unit: int) -> Column:
    """Whole elapsed units in a microsecond difference, truncated toward zero."""
    return ((delta_micros - delta_micros % F.lit(unit)) / F.lit(unit)).cast("bigint")


def day_number(day: Column, first_day: Column) -> Column:
    """1 on the install day, 2 on the day after, ..."""
    return (F.datediff(day, first_day) + 1).cast("bigint")


def year_start_micros(year: int) -> int:
    days = (dt.date(year, 1, 1) - dt.date(1970, 1, 1)).days
    return days * DAY_MICROS


def session_slot_width(gap_minutes: int) -> int:
    """Widest slot that nests in a UTC day and is not longer than the inactivity gap.

    Two events of one user in the same slot are then always less than a gap apart, so they
    belong to one session and can be merged before any ordering is needed.
    """
    day_minutes = DAY_MICROS // MINUTE_MICROS
    widest = next(m for m in range(min(gap_minutes, day_minutes), 0, -1) if day_minutes % m == 0)
    return widest * MINUTE_MICROS

"""Period labels used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week2(d: Column) -> Column:
    return F.lpad(F.weekofyear(d).cast("string"), 2, "0")


def period_label(d: Column, granularity: str) -> Column:
    """monthly 'YYYY-MM', daily 'YYYY-MM-DD', weekly 'YYYY-Www'.

    The weekly label pairs the calendar year with the ISO week number
    (so 2024-12-30 is '2024-W01'), as the strftime('%Y-W%V') it matches.
    """
    if granularity == "monthly":
        return F.date_format(d, "yyyy-MM")
    if granularity == "daily":
        return F.date_format(d, "yyyy-MM-dd")
    if granularity == "weekly":
        return F.concat(F.year(d).cast("string"), F.lit("-W"), iso_week2(d))
    raise ValueError(f"granularity must be daily, weekly or monthly: {granularity}")


def week_label(d: Column) -> Column:
    """'Week ww' with no year, so the same ISO week of different years merges."""
    return F.concat(F.lit("Week "), iso_week2(d))

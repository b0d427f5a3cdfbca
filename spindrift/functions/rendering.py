"""Values as people read them, and working time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(size: Column) -> Column:
    """Bytes in the largest unit below, rounded half up."""
    rounded = lambda unit: F.floor(size / unit + 0.5).cast("string")
    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
            .when(size < 1024**2, F.concat(rounded(1024), F.lit("KB")))
            .when(size < 1024**3, F.concat(rounded(1024**2), F.lit("MB")))
            .otherwise(F.concat(rounded(1024**3), F.lit("GB"))))


def format_time_spent(seconds: Column) -> Column:
    """Seconds as hours and minutes, leaving out what is zero."""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.when((hours > 0) & (minutes > 0), F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))).when(
        hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def business_hours(start: Column, end: Column) -> Column:
    """Eight hours for each Monday to Friday from start's day to end's, both included; 0 if end is before.

    Whole weeks count five days; the rest is read off the weekdays, so no day list is made.
    """
    a, b = F.to_date(start), F.to_date(end)
    days = F.datediff(b, a) + 1
    first = F.weekday(a)
    left = days % 7
    # of the left days, those that fall on the two days of the weekend
    weekend = F.greatest(F.lit(0), F.least(first + left, F.lit(7)) - F.greatest(first, F.lit(5))) + F.greatest(
        F.lit(0), first + left - F.lit(12))
    return F.when(days <= 0, F.lit(0)).otherwise(8 * (F.floor(days / 7) * 5 + left - weekend)).cast("long")

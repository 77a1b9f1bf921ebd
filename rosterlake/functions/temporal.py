"""Date columns.  The day that counts as today is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def months_apart(start: Column, end: Column) -> Column:
    """Difference of calendar months, days ignored."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def whole_months(start: Column, end: Column) -> Column:
    """Completed months from start to end, which is not earlier."""
    apart = months_apart(start, end)
    return apart - F.when(F.add_months(start, apart) > end, 1).otherwise(0)


def duration_months(start: Column, end: Column, current: Column, as_of: Column) -> Column:
    """Whole months, at least one; reversed dates are swapped; open or current ends at as_of."""
    last = F.when(F.coalesce(current, F.lit(False)), as_of).otherwise(F.coalesce(end, as_of))
    months = whole_months(F.least(start, last), F.greatest(start, last))
    return F.when(start.isNotNull(), F.greatest(months, F.lit(1)))


def backfilled_months(months: Column, start: Column, end: Column, current: Column, as_of: Column) -> Column:
    """months where given, else duration_months(); never under one."""
    return F.greatest(F.coalesce(months, duration_months(start, end, current, as_of)), F.lit(1))


def age_years(born: Column, as_of: Column) -> Column:
    return F.floor(whole_months(born, as_of) / 12).cast("int")


def deadline(submitted: Column, given: Column, days: int = 30) -> Column:
    return F.coalesce(given, F.date_add(submitted, days))


def unexpired(expires: Column, as_of: Column) -> Column:
    return expires.isNull() | (expires > as_of)

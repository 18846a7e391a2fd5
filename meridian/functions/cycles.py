"""Election cycles, half-years and weeks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_CYCLES = -1


def even_year(year: Column) -> Column:
    """Odd years belong to the cycle that ends a year later."""
    return (year + year % 2).cast("int")


def odd_down(year: Column) -> Column:
    """The other direction, as earmarks count: an odd fiscal year belongs to the year before."""
    return (year - year % 2).cast("int")


def to_cycle(date: Column) -> Column:
    return even_year(F.year(date))


def semi_annual(date: Column) -> Column:
    """`2009/0` for the first half of 2009, `2009/1` for the second."""
    return F.concat(F.year(date).cast("string"), F.lit("/"), F.when(F.month(date) > 6, "1").otherwise("0"))


def cycle_week(date: Column) -> Column:
    """Whole weeks since January 1 of the cycle's odd year."""
    start = F.make_date(to_cycle(date) - 1, F.lit(1), F.lit(1))
    return F.floor(F.date_diff(date, start) / 7).cast("int")


def cycle_or(date: Column, given: Column) -> Column:
    """The date's cycle, or the given one where there is no date."""
    return F.coalesce(to_cycle(date), given.cast("int"))

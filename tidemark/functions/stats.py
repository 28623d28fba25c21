"""Statistics as column expressions over aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054  #: fixed value: two-sided 95 % quantile of the normal distribution


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a rate, clipped to [0, 1]; null for no trials."""
    p = F.try_divide(hits, n)
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), mid - half)), F.when(some, F.least(F.lit(1.0), mid + half))


def mean_error(sd: Column, n: Column) -> Column:
    """Standard error of a mean; null below two values."""
    return F.when(n >= 2, sd / F.sqrt(n))


def welch_error(var_a: Column, n_a: Column, var_b: Column, n_b: Column) -> Column:
    """Standard error of a difference of means of two samples; null where either has fewer than two values."""
    return F.when((n_a >= 2) & (n_b >= 2), F.sqrt(var_a / n_a + var_b / n_b))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in (start, end]; 0 where end is not later. Whole weeks and a remainder, no calendar table."""
    days = F.datediff(end, start)
    first = F.weekday(start)  # Monday is 0
    rest = F.pmod(days, F.lit(7))
    # Weekend days among the `rest` days that follow `start`.
    saturday = F.pmod(5 - first, F.lit(7))
    sunday = F.pmod(6 - first, F.lit(7))
    within = lambda k: F.when((F.when(k == 0, 7).otherwise(k)) <= rest, 1).otherwise(0)
    count = F.floor(days / 7) * 5 + rest - within(saturday) - within(sunday)
    return F.when(days > 0, count.cast("int")).otherwise(F.when(days.isNotNull(), F.lit(0)))

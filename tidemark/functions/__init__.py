"""Column functions with explicit null, NaN and division rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for a value that is neither null, NaN nor infinite; never null."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def known(c: Column) -> Column:
    """The value where it is finite, else null."""
    return F.when(finite(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(a, b)


def round_to(c: Column, places: int) -> Column:
    """A double to so many places as SQL engines round it: the product with the power of ten, halves away from 0, over that power.

    F.round takes the shortest decimal text of the value instead, and parts with this where the product comes out as a half.
    What the product can't hold stays as it is.
    """
    power = F.lit(10.0**places)
    out = F.round(c * power) / power
    return F.when(finite(out), out).otherwise(c)


def padded_cik(c: Column) -> Column:
    """Left zeros up to ten places; a longer string stays whole."""
    s = F.trim(c.cast("string"))
    return F.when(F.length(s) >= 10, s).otherwise(F.lpad(s, 10, "0"))


def month_anchor(day: Column, months: int) -> Column:
    """The end of the month so many months before; 0 is the day itself."""
    return day if months == 0 else F.last_day(F.add_months(day, -months))


def fresh(value: Column, observed: Column, at: Column, days: int) -> Column:
    """The value where it is at most so many calendar days old, else null."""
    return F.when(F.datediff(at, observed) <= days, value)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate, null where either side does not vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null if a weight is not finite or the weights do not sum to more than 0."""
    total = F.sum(weight)
    return F.when(F.bool_and(finite(weight)) & (total > 0), F.try_divide(F.sum(value * weight), total))

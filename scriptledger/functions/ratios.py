"""Exact sums of money, zero-safe division and rounding.

Sums of money and of claims are exact, so their quotients are taken as
decimals: a quotient that lies on a rounding boundary then rounds away from
zero, which binary doubles would sometimes miss.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_sum(amount: Column) -> Column:
    """Sum of a decimal(14,2) as decimal(24,2).

    Adds whole cents as 64-bit integers, which is as exact as the decimal sum
    (under ANSI arithmetic, which the session sets, it raises rather than wraps) with a smaller and faster buffer.
    """
    cents = F.sum((amount * F.lit(100)).cast("bigint"))
    return (cents.cast("decimal(22,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(24,2)")


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` rounded half away from zero; NULL over 0."""
    quotient = F.try_divide(
        numerator.cast("decimal(24,2)"), denominator.cast("decimal(22,2)")
    )
    return F.round(quotient, digits).cast("double")


def percentage(part: Column, whole: Column, digits: int) -> Column:
    return ratio(part.cast("decimal(22,2)") * F.lit(100), whole, digits)


def scaled(amount: Column, unit: int, digits: int) -> Column:
    """Amount in units of ``unit`` dollars, as a decimal with ``digits``."""
    return F.round(amount.cast("decimal(26,2)") / F.lit(unit), digits)


def double_ratio(numerator: Column, denominator: Column) -> Column:
    """Unrounded quotient for products too wide for a decimal."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pearson(covariance: Column, spread_x: Column, spread_y: Column, varies: Column) -> Column:
    """Correlation from centred moments (a covariance and two standard deviations,
    all over the same count); NULL unless both sides vary.

    ``varies`` has to say so exactly (smallest < largest on both sides): rounding
    can leave the spread of equal values just above zero. The bounds only take
    off a last bit beyond 1.
    """
    r = F.try_divide(covariance, spread_x * spread_y)
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson_of(x: Column, y: Column) -> Column:
    """Aggregate: correlation of two double columns without NULLs."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return pearson(F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y), varies)

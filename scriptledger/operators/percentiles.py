"""Exact interpolated percentiles from a histogram.

Rows are first collapsed to (keys, value, frequency) by a hash aggregate that
combines before the shuffle, so a hot group moves one row per distinct value.
The percentile is then read off running frequencies in a window that can
spill; no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_THROUGH, _TOTAL = "_rows_through", "_rows_total"


def ranked_histogram(
    histogram: DataFrame, keys: Sequence[str], value: str, frequency: str
) -> DataFrame:
    """Add the running and the whole frequency of each group. ``value`` must
    have no NULLs and be distinct within ``keys``."""
    group = Window.partitionBy(*keys)
    through = group.orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return histogram.withColumn(
        _THROUGH, F.sum(frequency).over(through)
    ).withColumn(_TOTAL, F.sum(frequency).over(group))


def percentile_of_ranked(
    p: float, value: str, frequency: str, where: Column | None = None
) -> Column:
    """Aggregate over a ranked histogram: the ``p`` percentile as a double,
    interpolated between the two values around position ``p * (n - 1)``."""
    chosen = F.lit(True) if where is None else where
    position = F.lit(float(p)) * (F.col(_TOTAL) - 1)

    def value_at(row: Column) -> Column:
        holds = (F.col(_THROUGH) > row) & (F.col(_THROUGH) - F.col(frequency) <= row)
        return F.max(F.when(chosen & holds, F.col(value))).cast("double")

    below, above = value_at(F.floor(position)), value_at(F.ceil(position))
    fraction = F.max(F.when(chosen, position - F.floor(position)))
    return below * (1 - fraction) + above * fraction


def grouped_percentiles(
    rows: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """One row per group with a column per requested percentile; NULL values
    are ignored."""
    histogram = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_frequency"))
    )
    return (
        ranked_histogram(histogram, keys, value, "_frequency")
        .groupBy(*keys)
        .agg(
            *[
                percentile_of_ranked(p, value, "_frequency").alias(name)
                for name, p in points.items()
            ]
        )
    )

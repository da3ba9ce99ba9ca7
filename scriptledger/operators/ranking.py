"""Top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptledger.operators.prefix import Order, ordering, running


#: Rows of a group that one task may rank.
WINDOW_ROWS = 100_000


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Order], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1. NULL comes last.

    Up to the planner's limit on k (1000 by default) the rank filter is applied
    in each task before the shuffle too, if no other window stands beside it. For a
    larger k, filter by ``rank_cut`` first. Beyond ``WINDOW_ROWS`` a group is ranked by
    many tasks (``prefix.running``).
    """
    if k > WINDOW_ROWS:
        return running(rows, keys, order, rank).where(F.col(rank) <= k)
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering(order)))
    return rows.withColumn(rank, numbered).where(F.col(rank) <= k)


def rank_cut(frequencies: DataFrame, keys: Sequence[str], value: str, frequency: str, k: int) -> DataFrame:
    """Per group, the least value (NULL last) that the first ``k`` rows in falling
    order of ``value`` reach, as ``_least``, and whether they reach its NULLs, as
    ``_nulls``. The window has a row per distinct value."""
    ahead = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    before = F.coalesce(F.sum(frequency).over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        frequencies.withColumn("_before", before)
        .where(F.col("_before") < k)
        .groupBy(*keys)
        .agg(F.min(value).alias("_least"), F.bool_or(F.col(value).isNull()).alias("_nulls"))
    )


def may_rank(value: str) -> Column:
    """Rows at or above the cut of ``rank_cut``."""
    return F.col("_nulls") | (F.col(value) >= F.col("_least"))


def top_ranked(
    rows: DataFrame, order: Sequence[Column], n: int, rank: str
) -> DataFrame:
    """The first ``n`` rows overall, numbered from 1. The limit comes first, so
    the window sees ``n`` rows only."""
    numbered = F.row_number().over(Window.orderBy(*order))
    return rows.orderBy(*order).limit(n).withColumn(rank, numbered)


def distinct_options(rows: DataFrame, column: str, limit: int | None = 200) -> DataFrame:
    """Sorted distinct non-NULL values, as a filter list would offer them; ``None`` lists all."""
    found = (
        rows.select(column)
        .where(F.col(column).isNotNull())
        .distinct()
        .orderBy(column)
    )
    return found if limit is None else found.limit(limit)

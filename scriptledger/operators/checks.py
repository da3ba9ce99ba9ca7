"""Data-quality checks. Each returns what violates it; none is a pass.

Checks on a key collapse to one row per key first, so a key that holds much
of a table is counted in the tasks that read it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "n_records"


def is_outside(value: Column, low: Any = None, high: Any = None) -> Column:
    """Below ``low`` or above ``high``, both inclusive bounds; NULL is not."""
    outside = F.lit(False)
    if low is not None:
        outside = outside | (value < F.lit(low))
    if high is not None:
        outside = outside | (value > F.lit(high))
    return outside


def is_unexpected(value: Column, accepted: Sequence[Any]) -> Column:
    return value.isNotNull() & ~value.isin(list(accepted))


def not_null(rows: DataFrame, column: str) -> DataFrame:
    """Rows in which the column is NULL."""
    return rows.where(F.col(column).isNull())


def between(rows: DataFrame, column: str, low: Any = None, high: Any = None) -> DataFrame:
    """Rows in which the column is outside its bounds."""
    return rows.where(is_outside(F.col(column), low, high))


def _counted(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias(ROWS))


def unique(rows: DataFrame, column: str) -> DataFrame:
    """Non-NULL values that occur more than once."""
    present = rows.where(F.col(column).isNotNull())
    return _counted(present, column, "value").where(F.col(ROWS) > 1)


def accepted_values(rows: DataFrame, column: str, accepted: Sequence[Any]) -> DataFrame:
    """Non-NULL values outside the accepted set."""
    return _counted(rows.where(is_unexpected(F.col(column), accepted)), column, "value")


def relationships(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Non-NULL child keys that no parent row has."""
    keys = _counted(child.where(F.col(column).isNotNull()), column, "value")
    known = parent.select(F.col(parent_column).alias("value"))
    return keys.join(known, "value", "left_anti")

"""Joins against a curated lookup whose size is measured before it is
broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKUP_ROW_LIMIT = 50_000


def rows_up_to(lookup: DataFrame, row_limit: int = LOOKUP_ROW_LIMIT) -> int:
    """Number of rows, or ``row_limit + 1`` if there are more. Counting stops
    there."""
    return lookup.limit(row_limit + 1).count()


def fits_broadcast(lookup: DataFrame, row_limit: int = LOOKUP_ROW_LIMIT) -> bool:
    """Whether ``lookup`` has at most ``row_limit`` rows."""
    return rows_up_to(lookup, row_limit) <= row_limit


def hinted(side: DataFrame, small: bool) -> DataFrame:
    """``side`` with a broadcast hint if it is known to be small. Without one
    the planner shuffles both sides and splits hot keys at run time."""
    return F.broadcast(side) if small else side

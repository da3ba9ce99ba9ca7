"""Ordered rules applied once per distinct text instead of once per row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NameLimit:
    """Largest map of names that is broadcast."""

    rows: int = 200_000
    text_bytes: int = 32 << 20


def names_fit(names: DataFrame, column: str, limit: NameLimit) -> bool:
    """Whether ``names`` stays within both bounds. Counting stops at the first."""
    found = names.limit(limit.rows + 1).agg(
        F.count("*").alias("rows"), F.sum(F.octet_length(column).cast("long")).alias("text_bytes")
    ).first()
    return found["rows"] <= limit.rows and (found["text_bytes"] or 0) <= limit.text_bytes


def with_rule(
    frame: DataFrame, column: str, rule: Callable[[Column], Column], into: str, limit: NameLimit | None = None
) -> DataFrame:
    """``frame`` with ``rule(column)`` as ``into``, a text column's rule of any length.

    With a ``limit``, the distinct values of the column are counted first (a job that
    reads this column). If they fit, the rule is applied to each of them once
    and the outcomes are broadcast to the rows; else, and without a limit, it is
    applied to each row. Results are the same; a NULL gets what the rule makes of it.
    """
    if limit is None:
        return frame.withColumn(into, rule(F.col(column)))
    names = frame.where(F.col(column).isNotNull()).select(F.col(column).alias("_rule_name")).distinct()
    if not names_fit(names, "_rule_name", limit):
        return frame.withColumn(into, rule(F.col(column)))
    outcomes = names.select("_rule_name", rule(F.col("_rule_name")).alias("_rule_outcome"))
    found = frame.join(F.broadcast(outcomes), frame[column] == outcomes["_rule_name"], "left")
    missing = rule(F.lit(None).cast("string"))
    return found.withColumn(into, F.when(F.col(column).isNull(), missing).otherwise(F.col("_rule_outcome"))).drop(
        "_rule_name", "_rule_outcome"
    )

"""Ranks and running sums over groups of any size.

A window over a group is one task's. Here the order of all rows, group by group, is
cut into ranges at bounds read off a sample of fixed size; windows run within a
range, and what the ranges before hold of the same group is added from a table with a
row per range and group. Bounds decide how even the ranges are and nothing else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Ranges a caller gets without asking, and sampled rows for each.
RANGES, SAMPLED_PER_RANGE = 256, 24

#: A column name, and whether it rises. NULL comes last either way.
Order = tuple[str, bool]


def ordering(order: Sequence[Order]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if rises else F.col(c).desc_nulls_last() for c, rises in order]


def range_bounds(rows: DataFrame, order: Sequence[Order], ranges: int) -> list[Row]:
    """At most ``ranges - 1`` rows that cut ``rows`` into about equal parts. The
    sample are rows whose hashes are least, so its size does not depend on theirs."""
    names = [c for c, _ in order]
    sample = rows.select(*names).orderBy(F.xxhash64(*names)).limit(ranges * SAMPLED_PER_RANGE)
    found = sample.orderBy(*ordering(order)).collect()
    step = max(1, -(-len(found) // ranges))
    return list(dict.fromkeys(found[step::step]))


def comes_before(row: Row, order: Sequence[Order]) -> Column:
    """Whether the row at hand stands before ``row``."""
    before = F.lit(False)
    for name, rises in reversed(order):
        column, value = F.col(name), row[name]
        if value is None:
            less, equal = column.isNotNull(), column.isNull()
        else:
            less = F.coalesce(column < F.lit(value) if rises else column > F.lit(value), F.lit(False))
            equal = F.coalesce(column == F.lit(value), F.lit(False))
        before = less | (equal & before)
    return before


def range_number(bounds: Sequence[Row], order: Sequence[Order], first: int = 0) -> Column:
    """The range of the row at hand, found by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(comes_before(bounds[middle], order), range_number(bounds[:middle], order, first)).otherwise(
        range_number(bounds[middle + 1 :], order, first + middle + 1)
    )


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Order],
    number: str,
    sums: Mapping[str, str] | None = None,
    rank: str | None = None,
    total: str | None = None,
    ranges: int = RANGES,
) -> DataFrame:
    """``rows`` with ``number``, the row's place in its group from 1, running sums
    (new name to column, the row itself included), ``rank``, the place of the first
    row that equals it in the first column of ``order``, and ``total``, the group's
    rows. The last three are left out where no name is given.

    Groups are ordered by ``order``; rows that are equal in all of it share a
    range and stand in no particular order. Keys must not be NULL. ``rows`` is read
    for the sample when this is called; when run, its one shuffle serves both the
    rows and what the ranges hold.
    """
    by_group = [(key, True) for key in keys]
    bounds = range_bounds(rows, [*by_group, *order], ranges)
    sums = dict(sums or {})
    value, rises = order[0]
    within = Window.partitionBy("_range", *keys)
    ordered = within.orderBy(*ordering(order))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {"_number": F.row_number().over(ordered)} | {f"_sum{i}": F.sum(column).over(so_far) for i, column in enumerate(sums.values())}
    if rank:
        inside["_rank"] = F.rank().over(within.orderBy(*ordering([(value, rises)])))
    placed = rows.withColumn("_range", range_number(bounds, [*by_group, *order])).withColumns(inside)

    # In the windows' partitioning: what each range holds of a group.
    last = lambda c: F.max_by(c, "_number")
    held = placed.groupBy("_range", *keys).agg(
        F.max("_number").cast("long").alias("_held"),
        *[last(f"_sum{i}").alias(f"_held{i}") for i in range(len(sums))],
        *([F.min_by(value, "_number").alias("_first"), last(value).alias("_last"), last("_rank").alias("_last_rank")] if rank else []),
    )
    group = Window.partitionBy(*keys or [F.lit(1)])
    ahead = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = {"_before": F.coalesce(F.sum("_held").over(ahead), F.lit(0)), "_total": F.sum("_held").over(group)}
    offsets = held.withColumns(before | {f"_before{i}": F.sum(f"_held{i}").over(ahead) for i in range(len(sums))})
    if rank:
        # A range's first value may stand in ranges before it too: its place is that of the first of all.
        ends = F.array(_end("_first", F.col("_before") + 1), _end("_last", F.col("_before") + F.col("_last_rank")))
        equal = Window.partitionBy(*keys, "_value")
        offsets = offsets.withColumn("_end", F.explode(ends)).select("*", "_end.*").withColumn("_start", F.min("_place").over(equal)).where("_which = '_first'")
    taken = ["_range", *keys, "_before", "_total", *[f"_before{i}" for i in range(len(sums))], *(["_value", "_start"] if rank else [])]
    found = {number: F.col("_before") + F.col("_number")}
    for i, name in enumerate(sums):
        own, earlier = F.col(f"_sum{i}"), F.col(f"_before{i}")
        found[name] = F.coalesce(own + earlier, own, earlier)
    if rank:
        found[rank] = F.when(F.col(value).eqNullSafe(F.col("_value")), F.col("_start")).otherwise(F.col("_before") + F.col("_rank"))
    if total:
        found[total] = F.col("_total")
    joined = placed.join(offsets.select(*taken), ["_range", *keys])
    return joined.select(*rows.columns, *[column.alias(name) for name, column in found.items()])


def _end(which: str, place: Column) -> Column:
    return F.struct(F.lit(which).alias("_which"), F.col(which).alias("_value"), place.alias("_place"))


def percent_rank(rank: Column, total: Column) -> Column:
    """Share of the other rows of a group that stand before, 0 in a group of one."""
    return F.when(total > 1, (rank - 1) / (total - 1)).otherwise(F.lit(0.0))

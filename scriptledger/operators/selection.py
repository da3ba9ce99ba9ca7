"""Exact values at given ranks of many columns, by repeated histograms.

Each round counts, for every rank that is sought, the values between the bounds
known so far in bins of equal width, map-side first, and keeps the bin that holds
the rank, with the bin's least and greatest value as the next bounds. Nothing but
these counts is shuffled or collected, whatever the number of rows or values, and no
column is one task's.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins a rank and round.
BINS = 512


@dataclass
class Sought:
    """A rank (from 0) among the values of ``column`` from ``low`` to ``high``."""

    column: str
    rank: int
    low: float
    high: float

    @property
    def found(self) -> bool:
        return self.low == self.high

    def bin(self, value: Column) -> Column:
        """Rises with the value; the least is in the first bin and the greatest in the last."""
        half = 1.0 if math.isfinite(self.high - self.low) else 0.5
        share = (value * half - self.low * half) / (self.high * half - self.low * half)
        return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


@dataclass
class Extent:
    """Numbers of values of a column that order around the finite ones, and their bounds."""

    below: int
    finite: int
    above: int
    nan: int
    low: float | None
    high: float | None

    @property
    def n(self) -> int:
        return self.below + self.finite + self.above + self.nan

    def outside(self, rank: int) -> float | None:
        """The value at ``rank`` if it is not finite; NaN is the greatest."""
        for count, value in ((self.below, -math.inf), (self.finite, None), (self.above, math.inf), (self.nan, math.nan)):
            if rank < count:
                return value
            rank -= count
        raise IndexError(rank)


def extents(rows: DataFrame, columns: Sequence[str]) -> dict[str, Extent]:
    """Of all columns (doubles) in one pass; NULL does not count."""
    aggregates = []
    for i, name in enumerate(columns):
        value = F.col(f"`{name}`")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < math.inf)
        aggregates += [
            F.count_if(value == -math.inf).alias(f"below{i}"),
            F.count_if(finite).alias(f"finite{i}"),
            F.count_if(value == math.inf).alias(f"above{i}"),
            F.count_if(F.isnan(value)).alias(f"nan{i}"),
            F.min(F.when(finite, value)).alias(f"low{i}"),
            F.max(F.when(finite, value)).alias(f"high{i}"),
        ]
    if not columns:
        return {}
    row = rows.agg(*aggregates).first()
    return {name: Extent(*[row[f"{part}{i}"] for part in ("below", "finite", "above", "nan", "low", "high")]) for i, name in enumerate(columns)}


def values_at_ranks(rows: DataFrame, wanted: Mapping[str, Sequence[int]], known: Mapping[str, Extent] | None = None) -> dict[tuple[str, int], float]:
    """The value at each rank (from 0, rising) of each column, columns being doubles.

    ``rows`` is read once a round; a round divides the distance between bounds by
    ``BINS`` or more, and one whose bounds meet ends. Where that is dear, pass a
    written table.
    """
    known = known or extents(rows, list(wanted))
    out, open_ = {}, []
    for name, ranks in wanted.items():
        extent = known[name]
        for rank in dict.fromkeys(ranks):
            outside = extent.outside(rank)
            if outside is not None:
                out[name, rank] = outside
            else:
                open_.append((rank, Sought(name, rank - extent.below, extent.low, extent.high)))
    while True:
        out |= {(s.column, rank): s.low for rank, s in open_ if s.found}
        open_ = [(rank, s) for rank, s in open_ if not s.found]
        if not open_:
            return out
        # Ranks of one column often share their bounds.
        shared: dict[tuple[str, float, float], list[tuple[int, Sought]]] = {}
        for rank, s in open_:
            shared.setdefault((s.column, s.low, s.high), []).append((rank, s))
        cells = []
        for place, ((name, low, high), members) in enumerate(shared.items()):
            value = F.col(f"`{name}`")
            cell = F.struct(F.lit(place).alias("place"), members[0][1].bin(value).alias("bin"), value.alias("value"))
            cells.append(F.when(value.between(low, high), cell))
        inside = rows.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("c.*")
        counts = inside.groupBy("place", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        bins: dict[int, list] = {}
        for row in counts.collect():
            bins.setdefault(row.place, []).append(row)
        narrowed = []
        for place, members in enumerate(shared.values()):
            for rank, s in members:
                left = s.rank
                for row in sorted(bins[place], key=lambda r: r.bin):
                    if left < row.n:
                        narrowed.append((rank, Sought(s.column, left, row.low, row.high)))
                        break
                    left -= row.n
        open_ = narrowed


def quantiles(rows: DataFrame, columns: Sequence[str], points: Sequence[float]) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column (doubles): between the values around
    position ``p * (n - 1)``. NULL for a column without values."""
    known = extents(rows, columns)
    positions = {name: [p * (known[name].n - 1) for p in points] for name in columns if known[name].n}
    wanted = {name: [r for at in ats for r in (math.floor(at), math.ceil(at))] for name, ats in positions.items()}
    values = values_at_ranks(rows, wanted, known)

    def between(name: str, at: float) -> float:
        low, high = values[name, math.floor(at)], values[name, math.ceil(at)]
        share = at - math.floor(at)
        return low if low == high else low * (1 - share) + high * share

    return {name: [between(name, at) for at in positions[name]] if name in positions else [None] * len(points) for name in columns}

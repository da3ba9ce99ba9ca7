"""Profile of a result: its ends and statistics of its numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptledger.operators.ranking import top_ranked
from scriptledger.operators.selection import quantiles

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
PROFILE = "column_name string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"


def numeric_profile(rows: DataFrame, digits: int = 2) -> DataFrame:
    """Per numeric column: count, mean, std, min, quartiles, max; nothing for a result
    without rows.

    Quartiles are exact and found when this is called, by a few reads of ``rows`` that
    move counts only: pass a written table where ``rows`` is dear. The rest is one
    aggregate over all columns.
    """
    numeric = [field.name for field in rows.schema if isinstance(field.dataType, T.NumericType)]
    if not numeric:
        return rows.sparkSession.createDataFrame([], PROFILE)
    doubles = rows.select([F.col(f"`{name}`").cast("double").alias(name) for name in numeric])
    quartiles = quantiles(doubles, numeric, list(QUARTILES.values()))

    def line(name: str) -> Column:
        value = F.col(f"`{name}`")
        moments = {"mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value)}
        found = {point: F.lit(x).cast("double") for point, x in zip(QUARTILES, quartiles[name], strict=True)}
        statistics = moments | found | {"max": F.max(value)}
        return F.struct(
            F.lit(name).alias("column_name"),
            F.count(value).alias("count"),
            *[F.round(column, digits).alias(statistic) for statistic, column in statistics.items()],
        )

    lines = doubles.agg(F.count(F.lit(1)).alias("_rows"), F.array(*[line(name) for name in numeric]).alias("_lines"))
    return lines.where("_rows > 0").select(F.explode("_lines").alias("_line")).select("_line.*")


def first_and_last(
    rows: DataFrame,
    ascending: Sequence[Column],
    descending: Sequence[Column],
    max_rows: int = 20,
) -> DataFrame:
    """All rows if there are at most ``max_rows``, else the first and last
    halves, with ``n_rows`` and the position counted from either end.

    ``descending`` must be the exact reverse of ``ascending``. Both ends are
    top-k plans; nothing is sorted whole.
    """
    half = max_rows // 2
    n_rows = rows.agg(F.count(F.lit(1))).scalar()
    head = top_ranked(rows, ascending, max_rows, "place").withColumn("n_rows", n_rows)
    tail = top_ranked(rows, descending, half, "place").withColumn("n_rows", n_rows)
    few, many = F.col("n_rows") <= max_rows, F.col("n_rows") > max_rows
    return (
        head.where(few | (F.col("place") <= half))
        .withColumn("part", F.lit("head"))
        .unionByName(tail.where(many).withColumn("part", F.lit("tail")))
        .select("part", "place", "n_rows", *rows.columns)
    )

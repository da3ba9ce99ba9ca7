"""Replace-on-rerun sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def replace_parquet(
    frame: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    find_by: Sequence[str] = (),
    watch: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    **options: str,
) -> DataFrame:
    """Overwrite ``path`` and hand back a frame that reads it.

    With ``partition_by``, rows are rebalanced on it first: adaptive execution
    then splits a hot value over several files and merges small ones, where
    every task would otherwise write a file for each value.

    With ``cluster_by``, files hold ranges of those columns and are sorted by
    them, so that a filter on the first skips most files and row groups by their
    statistics. A second column spreads a hot value of the first over files; where the
    first is in ``partition_by`` too, a filter on the second skips within each directory.

    Row groups get a Bloom filter for each column of ``find_by``: a look-up of one value
    that is not in the order of the files skips the groups that lack it.

    ``watch`` gets the rows as they are written, after all that moves them.
    """
    rows = frame.hint("rebalance", *partition_by) if partition_by else frame
    if cluster_by:
        rows = frame.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    for column in find_by:
        # Sized to the values that a row group turns out to have.
        options |= {f"parquet.bloom.filter.enabled#{column}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    watch(rows).write.mode("overwrite").options(**options).partitionBy(*partition_by).parquet(path)
    return read_parquet(frame.sparkSession, path, frame.schema)


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """A written table; ``schema`` restores its column order if it was
    partitioned, which moves those columns to the end."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).parquet(path).select(schema.names)


def replace_bucketed(
    frame: DataFrame, table: str, column: str, buckets: int, path: str | None = None
) -> DataFrame:
    """Overwrite a catalog table bucketed and sorted by ``column``.

    Two tables bucketed alike join on ``column`` without a shuffle. Only for
    tables in which a value of ``column`` has few rows: all its rows share one
    bucket, and so one task.
    """
    writer = (
        frame.repartition(buckets, column)
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, column)
        .sortBy(column)
    )
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return frame.sparkSession.table(table)

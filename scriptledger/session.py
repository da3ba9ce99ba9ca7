"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "scriptledger", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and dates in UTC.

    Shuffle width, memory and the checkpoint folder are left to the cluster:
    pass them as keyword arguments (dots written as double underscores) only
    where nothing else sets them, as tests and the local bench do.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Hash instead of sort where a shuffle turned out small enough per task.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.session.timeZone": "UTC",
        # Sums raise instead of wrapping.
        "spark.sql.ansi.enabled": "true",
        **{key.replace("__", "."): str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for applications whose cluster names none.
OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests, local
    runs) a temporary one, the same for the whole application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        application = spark.sparkContext.applicationId
        folder = OWN_FOLDERS.get(application) or OWN_FOLDERS.setdefault(application, tempfile.mkdtemp(prefix="scriptledger-"))
    return folder.rstrip("/")


#: Has Spark remove the shuffle files of a job when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as Parquet in the shared folder and read again: lineage
    ends there, and a lost executor costs a reread instead of a recomputation.
    The shuffle files of the write are needed by nothing else and go with it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``durable``: those of which all that is read later has been written."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
            place = context._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)

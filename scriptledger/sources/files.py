"""CSV scans. Every column is read as text and coerced later."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptledger import schemas
from scriptledger.sources.csv_splits import read_csv_records

# Fixed value: name pattern of the extracted payments file, for one year or any.
OPEN_PAYMENTS_GLOB = "OP_DTL_GNRL_PGYR{year}*.csv"


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Files at ``path`` (a file, or the ones directly in a directory) whose name
    matches ``pattern``, sorted, as plain paths."""
    try:
        listing = spark.read.option("pathGlobFilter", pattern).text(path)
        # The listing's URIs are encoded; a path is not.
        return sorted(unquote(name) for name in listing.inputFiles())
    except AnalysisException as missing:
        raise FileNotFoundError(f"no such file or directory: {path}") from missing


def pick_file(spark: SparkSession, directory: str, pattern: str) -> str:
    """The one file in ``directory`` that matches ``pattern``. Several are an
    error: which of them are meant has to be said."""
    matches = list_files(spark, directory, pattern)
    if not matches:
        raise FileNotFoundError(f"no file matching {pattern} in {directory}")
    if len(matches) > 1:
        raise ValueError(f"{len(matches)} files match {pattern} in {directory}, name those to load: {matches}")
    return matches[0]


def read_text_columns(
    spark: SparkSession,
    paths: str | Sequence[str],
    header: dict[str, str],
    encoding: str = "ISO-8859-1",
    multi_line: bool = True,
) -> DataFrame:
    """The columns named in ``header``, renamed, as strings.

    ``paths``: a file, a directory, or several of them. Each file is read by its
    own header, so their columns may stand in different orders. A line with more
    fields than the header keeps the first ones and a shorter one is padded with
    NULL; no line is dropped. Quoted fields may hold line breaks. Files are read in
    parallel either way; ``multi_line=False`` saves the scan that looks for open
    quotes, for files known to have no line breaks within quotes. ``encoding`` must
    write ASCII as single bytes.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    each = [file for path in given for file in list_files(spark, path)]
    if not each:
        raise FileNotFoundError(f"no file in {given}")
    if multi_line:
        return read_csv_records(spark, each, header, encoding)
    options = {"header": True, "encoding": encoding, "escape": '"'}

    def one(path: str) -> DataFrame:
        found = spark.read.options(**options).csv(path).columns
        absent = [name for name in header if name not in found]
        if absent:
            raise ValueError(f"{path} lacks columns {absent}")
        declared = T.StructType([T.StructField(name, T.StringType()) for name in found])
        return (
            spark.read.options(**options)
            .schema(declared)
            .csv(path)
            .select([F.col(f"`{name}`").alias(column) for name, column in header.items()])
        )

    return reduce(DataFrame.unionByName, map(one, each))


def payment_files(spark: SparkSession, directory: str, years: Sequence[int] | None = None) -> list[str]:
    """The payments file in ``directory``, or one file for each of ``years``."""
    wanted = ["*"] if years is None else [str(year) for year in years]
    return [pick_file(spark, directory, OPEN_PAYMENTS_GLOB.format(year=year)) for year in wanted]


def read_open_payments(
    spark: SparkSession, directory: str, years: Sequence[int] | None = None, multi_line: bool = True
) -> DataFrame:
    """The files of ``payment_files``."""
    paths = payment_files(spark, directory, years)
    return read_text_columns(spark, paths, schemas.OPEN_PAYMENTS_HEADER, multi_line=multi_line)


def read_prescribers(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    return read_text_columns(spark, paths, schemas.PRESCRIBERS_HEADER, multi_line=multi_line)


def read_by_drug(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    return read_text_columns(spark, paths, schemas.BY_DRUG_HEADER, multi_line=multi_line)


def read_drug_seed(spark: SparkSession, path: str) -> DataFrame:
    """The curated brand -> manufacturer, class lookup, with declared types."""
    return spark.read.schema(schemas.DRUG_SEED).option("header", True).csv(path)

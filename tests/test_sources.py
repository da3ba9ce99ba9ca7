"""CSV scans that lose nothing, and dates as extracts write them."""

from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scriptledger.functions import columns as C
from scriptledger.sources import files, sinks

HEADER = {"NPI": "npi", "Name": "name"}


def read(spark, *paths, **options):
    return sorted(tuple(r) for r in files.read_text_columns(spark, [str(p) for p in paths], HEADER, **options).collect())


def test_quoted_line_break_is_one_record(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('NPI,Name\n1,"first\nsecond"\n2,x\n')
    assert read(spark, path) == [("1", "first\nsecond"), ("2", "x")]


def test_long_and_short_lines_stay(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("NPI,Name\n1,a,surplus,more\n2\n3,c\n")
    expected = [("1", "a"), ("2", None), ("3", "c")]
    for multi_line in (True, False):
        assert sorted(read(spark, path, multi_line=multi_line), key=str) == expected


def test_each_file_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("NPI,Name\n1,a\n")
    (folder / "b.csv").write_text("Name,Other,NPI\nb,z,2\n")
    assert read(spark, folder) == [("1", "a"), ("2", "b")]
    assert read(spark, folder / "b.csv", folder / "a.csv") == [("1", "a"), ("2", "b")]


def test_folder_with_a_space_and_several_years(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    line = ",".join(files.schemas.OPEN_PAYMENTS_HEADER)
    for year in (2021, 2022):
        (folder / f"OP_DTL_GNRL_PGYR{year}_P01.csv").write_text(f"{line}\n{year}\n")
    with pytest.raises(ValueError, match="2 files"):
        files.read_open_payments(spark, str(folder))
    assert files.read_open_payments(spark, str(folder), years=[2022]).count() == 1
    assert files.read_open_payments(spark, str(folder), years=[2021, 2022]).count() == 2


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("01/05/2022", date(2022, 1, 5)),
        ("1/5/2022", date(2022, 1, 5)),
        ("2022-01-05", date(2022, 1, 5)),
        ("2022-01-05 13:45:00", date(2022, 1, 5)),
        ("2022-01-05T13:45:00", date(2022, 1, 5)),
        ("1/5/2022 1:45:00 PM", date(2022, 1, 5)),
        ("1/5/2022 13:45", date(2022, 1, 5)),
        ("bad date", None),
        ("13/45/2022", None),
        ("", None),
        (None, None),
    ],
)
def test_lenient_dates(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(C.lenient_date(F.col("t"))).first()[0] == expected


def test_clustered_files_have_narrow_ranges(spark, tmp_path):
    """A hot company spans files, the others lie in one or two; a filter on one skips files."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("C"), (F.col("id") % 40).cast("string"))).alias("company_name"),
        F.col("id").cast("string").alias("physician_npi"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.replace_parquet(rows, str(tmp_path / "t"), cluster_by=["company_name", "physician_npi"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = []
    for file in (tmp_path / "t").glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        spans.append((group.column(0).statistics.min, group.column(0).statistics.max))
    assert len(spans) > 2
    assert sum(low <= "HOT" <= high for low, high in spans) > 1
    assert all(sum(low <= f"C{i}" <= high for low, high in spans) <= 2 for i in range(1, 40, 2))

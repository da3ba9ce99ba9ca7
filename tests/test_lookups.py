"""Look-ups of one physician skip nearly all row groups."""

import pytest
from pyspark.sql import functions as F

from scriptledger.plans import pipeline
from scriptledger.sources import sinks

SMALL_GROUPS = {"parquet.block.size": "4096", "parquet.page.size": "1024", "parquet.page.row.count.limit": "50", "parquet.block.row.count.limit": "200"}


def rows_read(frame):
    """Rows that the scans of a frame gave on, those of skipped row groups left out, and rows found."""
    frame = frame.select("*")
    found = len(frame.collect())
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())), found


@pytest.fixture
def off(spark):
    names = ["spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes"]
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def facts(spark, n=8000):
    """Half of the rows of one class and company; a physician is in a few of them."""
    rows = spark.range(n)
    scattered = F.pmod(F.xxhash64("id"), F.lit(n // 4))
    return rows.select(
        F.lpad(scattered.cast("string"), 10, "0").alias("physician_npi"),
        F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("C"), (F.col("id") % 60).cast("string"))).alias("company_name"),
        F.when(F.col("id") % 3 < 2, "hot class").otherwise(F.concat(F.lit("class "), (F.col("id") % 5).cast("string"))).alias("therapeutic_class"),
        F.col("id").alias("claims"),
    )


NPI = "0000000777"


@pytest.mark.parametrize("name", ["fact_prescriptions", "fact_payments"])
def test_a_physician_is_found_in_few_row_groups(spark, tmp_path, off, name):
    frame = facts(spark)
    partition, cluster, find = (options.get(name, ()) for options in (pipeline.PARTITIONED, pipeline.CLUSTERED, pipeline.FOUND_BY))
    told = sinks.replace_parquet(frame, str(tmp_path / "told"), partition, cluster, find, **SMALL_GROUPS)
    plain = sinks.replace_parquet(frame, str(tmp_path / "plain"), partition, **SMALL_GROUPS)
    expected = frame.where(F.col("physician_npi") == NPI).count()
    few, found = rows_read(told.where(F.col("physician_npi") == NPI))
    all_, same = rows_read(plain.where(F.col("physician_npi") == NPI))
    assert found == same == expected > 0
    assert few <= 0.15 * all_


def test_the_order_alone_serves_a_class_and_the_filter_alone_an_unordered_table(spark, tmp_path, off):
    frame = facts(spark)
    ordered = sinks.replace_parquet(frame, str(tmp_path / "ordered"), ["therapeutic_class"], ["therapeutic_class", "physician_npi"], **SMALL_GROUPS)
    in_class = ordered.where(F.col("therapeutic_class") == "hot class")
    few, found = rows_read(in_class.where(F.col("physician_npi") == NPI))
    assert found and few <= 0.15 * in_class.count()
    filtered = sinks.replace_parquet(frame, str(tmp_path / "filtered"), find_by=["physician_npi"], **SMALL_GROUPS)
    few, found = rows_read(filtered.where(F.col("physician_npi") == NPI))
    assert found and few <= 0.3 * frame.count()
    nothing, none = rows_read(filtered.where(F.col("physician_npi") == "0000000777X"))
    assert none == 0 and nothing <= 0.05 * frame.count()

import random
from collections import Counter

from conftest import SMALL
from frames import rows, warehouse

from scriptledger import registry
from scriptledger.operators import checks
from scriptledger.plans import quality_suite


def test_each_check_finds_what_is_wrong(spark):
    frame = spark.createDataFrame(
        [("a", 1), ("a", 5), ("b", 11), (None, None), (None, 0)], "k string, v int"
    )
    parent = spark.createDataFrame([("a",), (None,)], "id string")
    assert rows(checks.not_null(frame, "k")) == [(None, 0), (None, None)]
    assert rows(checks.unique(frame, "k")) == [("a", 2)]
    assert rows(checks.accepted_values(frame, "k", ["a"])) == [("b", 1)]
    assert rows(checks.relationships(frame, "k", parent, "id")) == [("b", 1)]
    assert rows(checks.between(frame, "v", 1, 10)) == [("b", 11), (None, 0)]
    assert rows(checks.between(frame, "v", high=10)) == [("b", 11)]
    assert checks.between(frame, "v").count() == 0


def test_clean_data_passes(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 10)], "k string, v int")
    assert checks.not_null(frame, "k").isEmpty()
    assert checks.unique(frame, "k").isEmpty()
    assert checks.accepted_values(frame, "k", ["a", "b"]).isEmpty()
    assert checks.relationships(frame, "k", frame, "k").isEmpty()
    assert checks.between(frame, "v", 1, 10).isEmpty()


def test_the_suite_is_complete():
    assert len(quality_suite.SUITE) == 57
    assert Counter(check.test for check in quality_suite.SUITE) == {
        "not_null": 41,
        "unique": 6,
        "accepted_values": 5,
        "between": 3,
        "relationships": 2,
    }
    assert len(set(map(repr, quality_suite.SUITE))) == 57


def test_report_counts_failures(spark):
    w = warehouse(
        spark,
        paid=[("1", "Pfizer", -3, "Gift", "NY"), (None, "Pfizer", 3, "Gift", "NY")],
        who=[("1", "Urology", "NY", "5", "1", "1"), ("01", "Urology", "NY", None, "1", "1")],
        drugs=[("1", "Alpha", "g", None, 1)],
        lookup=[("Alpha", "g", "PFIZER", "Oncology"), ("alpha", "g", "MERCK", "Astrology")],
    )
    report = quality_suite.report(w).collect()
    assert len(report) == 57
    failed = {(r.table_name, r.column_name, r.test): r.failures for r in report if not r.passed}
    assert failed == {
        ("open_payments", "physician_npi", "not_null"): 1,
        ("open_payments", "payment_amount_usd", "between"): 1,
        ("part_d_prescribers", "total_claim_count", "not_null"): 1,
        ("part_d_by_drug", "total_claim_count", "not_null"): 1,
        ("drug_company_seed", "therapeutic_class", "accepted_values"): 1,
        ("stg_part_d_prescribers", "physician_npi", "unique"): 1,
        ("int_drug_company_mapping", "drug_brand_name_upper", "unique"): 1,
        ("int_physician_drug_prescribing", "company_claim_count", "not_null"): 2,
        ("dim_physician", "physician_npi", "unique"): 1,
    }


def test_orphan_rows_are_counted_each(spark):
    from scriptledger.plans.quality_suite import Check, report

    random.seed(1)
    npis = [random.choice(["known", "stray", "hot", "hot"]) for _ in range(200)]
    w = warehouse(spark)
    w.tables["fact_payments"] = spark.createDataFrame([(n,) for n in npis], "physician_npi string")
    w.tables["dim_physician"] = spark.createDataFrame([("known",)], "physician_npi string")
    check = Check(
        "fact_payments",
        "physician_npi",
        "relationships",
        {"parent": "dim_physician", "parent_column": "physician_npi"},
    )
    assert report(w, [check]).first().failures == sum(n != "known" for n in npis)


def test_the_registered_report_joins_its_raw_tables_once(spark, small):
    """What the checks read are written raw tables, without the joins below them."""
    found = registry.QUERIES["dq_report"](spark, SMALL)
    assert not [file for file in found.inputFiles() if "/lineitem" in file or "/orders" in file]
    assert rows(found) == rows(quality_suite.report(small))


def test_a_model_is_checked_in_the_one_that_carries_it(spark):
    w = warehouse(spark, paid=[("1", "Pfizer", 3, "Gift", "NY"), ("2", " ", 4, None, None)], lookup=[("Alpha", "g", "PFIZER", "Oncology")])
    carried = quality_suite.report(w, carried={"stg_open_payments": "fact_payments"})
    assert rows(carried) == rows(quality_suite.report(w))
    assert {r.table_name for r in carried.collect()} == {check.table for check in quality_suite.SUITE}

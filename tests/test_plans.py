"""What the planner makes of the queries: the shapes that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from frames import rows, warehouse

from scriptledger.operators.lookup import fits_broadcast
from scriptledger.plans import analyses, pipeline, views
from scriptledger.plans.intermediate import prescribing_totals
from scriptledger.plans.warehouse import Warehouse


def physical(frame):
    """The physical plan, before adaptive execution changes it."""
    return frame._jdf.queryExecution().sparkPlan().toString() + "\n===\n" + (
        frame._jdf.queryExecution().executedPlan().toString()
    )


@pytest.fixture
def no_auto_broadcast(spark):
    """Tables here are tiny; as if they were not."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.unset("spark.sql.optimizer.runtime.bloomFilter.enabled")


@pytest.fixture(scope="module")
def mart(spark, small, tmp_path_factory):
    return pipeline.build_mart(small, str(tmp_path_factory.mktemp("mart"))).warehouse


def exchanges(plan):
    return len(re.findall(r"Exchange hashpartitioning", plan.split("===")[1]))


def test_a_counted_lookup_is_broadcast(small, no_auto_broadcast):
    plan = physical(small.fact_prescriptions)
    assert "BroadcastHashJoin [upper(trim" in plan


def test_a_large_lookup_is_not(spark, no_auto_broadcast):
    lookup = [(f"b{i}", "g", "PFIZER", "Oncology") for i in range(5)]
    drugs = [("1", f"b{i % 7}", "g", 1, 1) for i in range(70)]
    small = warehouse(spark, drugs=drugs, lookup=lookup)
    large = warehouse(spark, drugs=drugs, lookup=lookup, lookup_row_limit=4)
    assert small.lookup_is_small and not large.lookup_is_small
    plan = physical(large.fact_prescriptions)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert rows(small.fact_prescriptions) == rows(large.fact_prescriptions)
    assert fits_broadcast(large.drug_company_seed, 5)


def test_the_cut_of_a_class_is_broadcast_only_while_the_lookup_is_small(mart, no_auto_broadcast):
    unbounded = Warehouse(mart.tables, lookup_row_limit=0)
    for top in (100, 1_000_000):
        assert "BroadcastHashJoin" in physical(analyses.kol_identification(mart, top=top))
        assert "BroadcastHashJoin" not in physical(analyses.kol_identification(unbounded, top=top))


def test_rows_below_the_cut_are_dropped_before_a_class_meets(mart):
    """For a number of leaders that the planner itself would not cut."""
    plan = physical(analyses.kol_identification(mart, top=2000))
    last_window = plan.index("row_number()")
    assert "_least" in plan[last_window:] and "_nulls" in plan[last_window:]


@pytest.mark.parametrize(
    "view",
    [
        views.dashboard_kpis,
        views.spend_by_company,
        views.spend_by_specialty,
        views.company_options,
        lambda w: views.company_kpis(w, "PFIZER"),
        lambda w: views.company_specialty_mix(w, "PFIZER"),
        lambda w: views.company_top_physicians(w, "PFIZER"),
        views.market_company_options,
    ],
)
def test_company_views_scan_the_bridge_and_no_payments(mart, view):
    # Plans cut long paths; the list of files does not.
    read = {folder for file in view(mart).inputFiles() for folder in file.split("/")}
    assert "bridge_physician_company_payments" in read and "fact_payments" not in read


def test_the_outer_join_reuses_the_partitioning_of_its_inputs(small, no_auto_broadcast):
    paid = small.int_physician_payments_agg.select("physician_npi", "company_name", "payment_count")
    prescribed = prescribing_totals(small.fact_prescriptions)
    separate = exchanges(physical(paid)) + exchanges(physical(prescribed))
    joined = paid.join(prescribed, ["physician_npi", "company_name"], "full_outer")
    assert exchanges(physical(joined)) == separate


def test_one_shuffle_for_sums_per_physician_and_their_join(mart, no_auto_broadcast):
    """Payments, physicians, then specialties."""
    assert exchanges(physical(views.spend_by_specialty(mart))) == 3


def test_distinct_prescribers_reuse_the_join_partitioning(mart, no_auto_broadcast):
    """Prescriptions, physicians, then states."""
    by_state = analyses.prescribing_by_state(mart.fact_prescriptions, mart.dim_physician)
    assert exchanges(physical(by_state)) == 3


def test_top_k_reports_do_not_sort_everything(mart):
    for report in (
        views.spend_by_specialty(mart),
        views.company_top_physicians(mart, "PFIZER"),
        views.kol_finder(mart, "Oncology"),
        views.under_invested(views.market_map(mart)),
    ):
        assert "TakeOrderedAndProject" in physical(report)


def test_top_per_class_is_cut_before_the_shuffle(mart):
    plan = physical(analyses.kol_identification(mart))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_no_nested_loops(mart):
    for query in (
        analyses.kol_identification(mart),
        analyses.geographic_market_analysis(mart),
        analyses.payment_prescribing_correlation(mart),
        views.market_map(mart, "PFIZER"),
        views.dashboard_kpis(mart),
        views.kol_finder(mart, "Oncology", states=["AS"], paid=True),
    ):
        plan = physical(query)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "Python" not in plan


def test_filters_and_columns_reach_the_scan(mart):
    plan = physical(views.company_category_mix(mart, "PFIZER"))
    assert "EqualTo(company_name,PFIZER)" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", read)) == {
        "company_name",
        "payment_amount_usd",
        "payment_category",
    }


def test_a_class_filter_prunes_directories(mart):
    one_class = mart.fact_prescriptions.where(F.col("therapeutic_class") == "Oncology")
    assert re.search(r"PartitionFilters: \[isnotnull\(therapeutic_class", physical(one_class))
    listed = {path.split("therapeutic_class=")[1].split("/")[0] for path in mart.fact_prescriptions.inputFiles()}
    assert len(listed) == 9


def test_bucketed_tables_join_without_a_shuffle(spark, small, tmp_path, no_auto_broadcast):
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed")
    built = pipeline.build_mart(small, str(tmp_path), bucket_schema="bucketed", buckets=4).warehouse
    joined = built.bridge_physician_company_payments.join(
        built.dim_physician.select("physician_npi", "specialty"), "physician_npi"
    )
    assert exchanges(physical(joined)) == 0
    plain = small.bridge_physician_company_payments.join(
        small.dim_physician.select("physician_npi", "specialty"), "physician_npi"
    )
    assert rows(joined) == rows(plain)
    assert rows(built.fact_payment_prescribing) == rows(
        small.fact_payment_prescribing, *built.fact_payment_prescribing.columns
    )
    spark.sql("DROP DATABASE bucketed CASCADE")


def test_written_models_are_used_as_they_are(spark, small):
    w = Warehouse(small.tables)
    marker = small.bridge_physician_company_payments.limit(0)
    w.tables["bridge_physician_company_payments"] = marker
    assert views.dashboard_kpis(w).first().payment_count == 0

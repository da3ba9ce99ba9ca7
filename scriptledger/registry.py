"""Every query by name, over the driver tables, with fixed arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptledger.functions import columns as C
from scriptledger.functions import rules
from scriptledger.operators import checks
from scriptledger.operators.distinct_rules import NameLimit
from scriptledger.operators.lookup import hinted
from scriptledger.operators.profile import first_and_last, numeric_profile
from scriptledger.operators.shares import share_of_total
from scriptledger.plans import analyses, quality_suite, views
from scriptledger.plans.warehouse import INTERMEDIATE, MART, RAW, STAGING, Warehouse
from scriptledger.sources import driver_tables, load
from scriptledger.sources.scratch import durable

Query = Callable[[SparkSession, str], DataFrame]

COMPANY, SPECIALTY, CLASS = "PFIZER", "Cardiology", "Oncology"
STATES = ["AS", "BS"]

_opened: dict[tuple[str, str], Warehouse] = {}


def warehouse_over(spark: SparkSession, directory: str) -> Warehouse:
    """Lazy models over the adapted driver tables; one per session and folder,
    so that the lookup is measured once."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _opened:
        _opened[key] = Warehouse(
            {
                "open_payments": driver_tables.open_payments(spark, directory),
                "part_d_prescribers": driver_tables.part_d_prescribers(spark, directory),
                "part_d_by_drug": driver_tables.part_d_by_drug(spark, directory),
                "drug_company_seed": driver_tables.drug_seed(spark, directory),
            }
        )
    return _opened[key]


def plain_numbers(frame: DataFrame) -> DataFrame:
    """Decimals as doubles, the only step between a query and its comparison.
    Sums are exact by then."""
    return frame.select(
        [
            F.col(field.name).cast("double").alias(field.name)
            if isinstance(field.dataType, T.DecimalType)
            else F.col(field.name)
            for field in frame.schema
        ]
    )


def _model(name: str) -> Callable[[Warehouse], DataFrame]:
    return lambda warehouse: warehouse.table(name)


def _load_payments(w: Warehouse) -> DataFrame:
    return load.load_open_payments(driver_tables.as_text(w.open_payments))


def _load_prescribers(w: Warehouse) -> DataFrame:
    return load.load_part_d_prescribers(driver_tables.as_text(w.part_d_prescribers))


def _load_by_drug(w: Warehouse) -> DataFrame:
    tracked = hinted(w.drug_company_seed, w.lookup_is_small)
    return load.load_part_d_by_drug(driver_tables.as_text(w.part_d_by_drug), tracked)


def _canonical_company(w: Warehouse) -> DataFrame:
    cleaned = w.open_payments.withColumn("cleaned", C.key_text(F.col("company_name")))
    return cleaned.groupBy(
        "company_name", C.canonical_company(F.col("cleaned")).alias("canonical_company")
    ).agg(F.count(F.lit(1)).alias("n"))


def _payment_category(w: Warehouse) -> DataFrame:
    category = C.payment_category(F.col("payment_nature")).alias("payment_category")
    return w.open_payments.groupBy("payment_nature", category).agg(F.count(F.lit(1)).alias("n"))


def _canonical_specialty(w: Warehouse) -> DataFrame:
    specialty = C.canonical_specialty(F.col("specialty")).alias("canonical_specialty")
    return w.part_d_prescribers.groupBy("specialty", specialty).agg(
        F.count(F.lit(1)).alias("n")
    )


def _display_id(w: Warehouse) -> DataFrame:
    return w.dim_physician.select("physician_npi", "physician_display_id")


def _size_bucket(w: Warehouse) -> DataFrame:
    return w.fact_payments.groupBy("payment_size_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("payment_amount_usd").alias("amount_usd")
    )


def _kols(w: Warehouse, **options) -> DataFrame:
    return views.kol_finder(w, CLASS, **options)


def _profiled(w: Warehouse) -> DataFrame:
    return numeric_profile(views.spend_by_specialty(w))


def _ends(w: Warehouse) -> DataFrame:
    spend = F.col("spend_millions")
    return first_and_last(
        views.spend_by_specialty(w),
        [spend.asc(), F.col("specialty").asc()],
        [spend.desc(), F.col("specialty").desc()],
        max_rows=8,
    )


#: Raw tables with a join or a grouping below them, which many of the checked models read.
REPORT_TABLES = ["drug_company_seed", "open_payments", "part_d_by_drug"]


def _dq_report(w: Warehouse) -> DataFrame:
    """The report over raw tables that are written once, so that the joins below them do not
    run again for each model that is checked, with rules applied once per distinct name.
    Written anew for each call."""
    raw = {name: w.table(name) for name in RAW}
    raw |= {name: durable(raw[name], f"report-{name}") for name in REPORT_TABLES}
    written = Warehouse(raw, w.lookup_row_limit, names=NameLimit())
    written.lookup_rows = w.lookup_rows
    return quality_suite.report(written, carried={"stg_open_payments": "fact_payments"})


BUILDERS: dict[str, Callable[[Warehouse], DataFrame]] = {
    # loads
    "load_open_payments": _load_payments,
    "load_part_d_prescribers": _load_prescribers,
    "load_part_d_by_drug": _load_by_drug,
    # models
    **{name: _model(name) for name in [*STAGING, *INTERMEDIATE, *MART]},
    # expressions
    "canonical_company": _canonical_company,
    "payment_category": _payment_category,
    "canonical_specialty": _canonical_specialty,
    "display_id": _display_id,
    "payment_size_bucket": _size_bucket,
    # analyses
    "kol_identification": analyses.kol_identification,
    "payment_prescribing_correlation": analyses.payment_prescribing_correlation,
    "payment_prescribing_correlation_min3": lambda w: analyses.payment_prescribing_correlation(
        w, min_n=3
    ),
    "company_spend_efficiency": analyses.company_spend_efficiency,
    "geographic_market_analysis": analyses.geographic_market_analysis,
    "physician_loyalty_scoring": analyses.physician_loyalty_scoring,
    # dashboard
    "dashboard_kpis": views.dashboard_kpis,
    "spend_by_company": views.spend_by_company,
    "spend_by_category": views.spend_by_category,
    "spend_by_specialty": views.spend_by_specialty,
    "paid_vs_unpaid_claims": views.paid_vs_unpaid_claims,
    # key prescribers
    "therapeutic_class_options": views.therapeutic_class_options,
    "state_options": views.state_options,
    "kol_finder": _kols,
    "kol_finder_states": lambda w: _kols(w, states=STATES),
    "kol_finder_paid": lambda w: _kols(w, paid=True),
    "kol_finder_unpaid": lambda w: _kols(w, paid=False),
    "kol_points": lambda w: views.kol_points(_kols(w)),
    "kol_display_table": lambda w: views.kol_display_table(_kols(w)),
    # one company
    "company_options": views.company_options,
    "company_kpis": lambda w: views.company_kpis(w, COMPANY),
    "company_specialty_mix": lambda w: views.company_specialty_mix(w, COMPANY),
    "company_category_mix": lambda w: views.company_category_mix(w, COMPANY),
    "company_geography": lambda w: views.company_geography(w, COMPANY),
    "company_top_physicians": lambda w: views.company_top_physicians(w, COMPANY),
    "company_top_physicians_by_npi": lambda w: views.company_top_physicians(
        w, COMPANY, by_npi=True
    ),
    "company_display_table": lambda w: views.company_display_table(
        views.company_top_physicians(w, COMPANY)
    ),
    # payment against prescribing
    "paid_rx_company_options": views.paid_rx_company_options,
    "specialty_options": views.specialty_options,
    "payment_group_summary": lambda w: views.payment_group_summary(w, COMPANY),
    "payment_group_summary_specialty": lambda w: views.payment_group_summary(
        w, COMPANY, SPECIALTY
    ),
    "lift_ratio": lambda w: views.lift_ratio(w, COMPANY),
    "lift_ratio_specialty": lambda w: views.lift_ratio(w, COMPANY, SPECIALTY),
    "payment_rx_points": lambda w: views.payment_rx_points(w, COMPANY),
    "payment_rx_points_specialty": lambda w: views.payment_rx_points(w, COMPANY, SPECIALTY),
    "payment_rx_pearson": lambda w: views.payment_rx_pearson(w, COMPANY),
    "payment_rx_pearson_specialty": lambda w: views.payment_rx_pearson(w, COMPANY, SPECIALTY),
    # market map
    "market_company_options": views.market_company_options,
    "market_map": views.market_map,
    "market_map_company": lambda w: views.market_map(w, COMPANY),
    "under_invested": lambda w: views.under_invested(views.market_map(w)),
    "under_invested_company": lambda w: views.under_invested(views.market_map(w, COMPANY)),
    "over_invested": lambda w: views.over_invested(views.market_map(w)),
    "over_invested_company": lambda w: views.over_invested(views.market_map(w, COMPANY)),
    # any result
    "filter_options": lambda w: views.filter_options(w, "fact_payments", "payment_category"),
    "share_of_total": lambda w: share_of_total(
        views.company_category_mix(w, COMPANY), "payment_category", "spend_k"
    ),
    "result_profile": _profiled,
    "result_first_and_last": _ends,
    # data quality, each on a table that does break it
    "dq_not_null": lambda w: checks.not_null(w.fact_payment_prescribing, "specialty"),
    "dq_unique": lambda w: checks.unique(w.fact_payments, "physician_npi"),
    "dq_accepted_values": lambda w: checks.accepted_values(
        w.stg_open_payments, "payment_category", rules.CATEGORIES[:10]
    ),
    "dq_relationships": lambda w: checks.relationships(
        w.fact_prescriptions, "physician_npi", w.dim_physician, "physician_npi"
    ),
    "dq_between": lambda w: checks.between(w.fact_payments, "payment_amount_usd", 50, 10_000),
    "dq_report": _dq_report,
}


def _query(builder: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, directory: plain_numbers(builder(warehouse_over(spark, directory)))


QUERIES: dict[str, Query] = {name: _query(builder) for name, builder in BUILDERS.items()}

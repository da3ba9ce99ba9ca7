"""Parameterised queries of the interactive views.

All sums by physician or company are taken before a join to a dimension, so
that a hot key is combined where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptledger.functions import columns as C
from scriptledger.functions import rules
from scriptledger.functions.ratios import money_sum, pearson_of, ratio, scaled
from scriptledger.operators.lookup import hinted
from scriptledger.operators.percentiles import percentile_of_ranked, ranked_histogram
from scriptledger.operators.ranking import distinct_options, top_ranked
from scriptledger.plans import analyses
from scriptledger.plans.warehouse import Warehouse

MILLION, THOUSAND = 1_000_000, 1_000


def filter_options(
    warehouse: Warehouse, table: str, column: str, limit: int = 200
) -> DataFrame:
    return distinct_options(warehouse.table(table), column, limit)


def _display_names(warehouse: Warehouse, rows: DataFrame, alias: str) -> DataFrame:
    """``rows`` (with a ``company_name``) and the display name, which falls
    back to the key."""
    names = warehouse.dim_company.select("company_name", "company_display_name")
    shown = F.coalesce("company_display_name", "company_name")
    return (
        rows.join(names, "company_name", "left")
        .withColumn(alias, shown)
        .drop("company_display_name")
    )


def _spend(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(money_sum(F.col("payment_amount_usd")).alias("spend"))


def _paid(pairs: DataFrame, key: str) -> DataFrame:
    """As ``_spend``, from the bridge: its rows are sums per physician and company."""
    return pairs.groupBy(key).agg(F.sum("total_payment_usd").alias("spend"))


def _spend_by_specialty(warehouse: Warehouse, pairs: DataFrame) -> DataFrame:
    known = warehouse.dim_physician.where(C.known_specialty(F.col("specialty")))
    return (
        _paid(pairs, "physician_npi")
        .join(known.select("physician_npi", "specialty"), "physician_npi")
        .groupBy("specialty")
        .agg(F.sum("spend").alias("spend"))
    )


def _of_company(warehouse: Warehouse, company: str) -> DataFrame:
    return warehouse.fact_payments.where(F.col("company_name") == F.lit(company))


def _pairs_of_company(warehouse: Warehouse, company: str) -> DataFrame:
    return warehouse.bridge_physician_company_payments.where(F.col("company_name") == F.lit(company))


# --- dashboard ------------------------------------------------------------


def dashboard_kpis(warehouse: Warehouse) -> DataFrame:
    """One row of totals, from the bridge: the two distinct counts expand its row
    per pair instead of every payment."""
    return warehouse.bridge_physician_company_payments.agg(
        F.sum("total_payment_usd").alias("total_payments"),
        F.coalesce(F.sum("payment_count"), F.lit(0)).alias("payment_count"),
        F.countDistinct("company_name").alias("companies"),
        F.countDistinct("physician_npi").alias("paid_physicians"),
    )


def spend_by_company(warehouse: Warehouse) -> DataFrame:
    per_company = _paid(warehouse.bridge_physician_company_payments, "company_name")
    return (
        _display_names(warehouse, per_company, "company")
        .groupBy("company")
        .agg(scaled(F.sum("spend"), MILLION, 2).alias("spend_millions"))
        .orderBy(F.desc("spend_millions"), "company")
    )


def spend_by_category(warehouse: Warehouse) -> DataFrame:
    return (
        _spend(warehouse.fact_payments, "payment_category")
        .select("payment_category", scaled(F.col("spend"), MILLION, 2).alias("spend_millions"))
        .orderBy(F.desc("spend_millions"), "payment_category")
    )


def spend_by_specialty(warehouse: Warehouse, top: int = 12) -> DataFrame:
    return (
        _spend_by_specialty(warehouse, warehouse.bridge_physician_company_payments)
        .select("specialty", scaled(F.col("spend"), MILLION, 2).alias("spend_millions"))
        .orderBy(F.desc("spend_millions"), "specialty")
        .limit(top)
    )


def paid_vs_unpaid_claims(warehouse: Warehouse) -> DataFrame:
    claims = F.col("total_claim_count")
    group = C.paid_group(F.col("received_pharma_payments")).alias("group_label")
    return (
        warehouse.dim_physician.where(claims.isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n_physicians"), F.sum(claims).alias("claims"))
        .select(
            "group_label",
            "n_physicians",
            ratio(F.col("claims"), F.col("n_physicians"), 0).alias("avg_claims"),
        )
    )


# --- key prescribers ------------------------------------------------------


def therapeutic_class_options(warehouse: Warehouse) -> DataFrame:
    return (
        warehouse.fact_prescriptions.select("therapeutic_class")
        .distinct()
        .orderBy(F.col("therapeutic_class").asc_nulls_last())
    )


def state_options(warehouse: Warehouse) -> DataFrame:
    state = F.col("state")
    return warehouse.dim_physician.where(C.valid_state(state)).select(state).distinct().orderBy(state)


def kol_finder(
    warehouse: Warehouse,
    therapeutic_class: str,
    states: Sequence[str] | None = None,
    paid: bool | None = None,
    n: int = 50,
) -> DataFrame:
    """The ``n`` specialists with most claims in a class, and what companies
    with a prescribed drug in that class paid them. ``paid`` keeps only the
    paid (True) or the unpaid (False)."""
    in_class = warehouse.fact_prescriptions.where(
        F.col("therapeutic_class") == F.lit(therapeutic_class)
    )
    physicians = warehouse.dim_physician.where(C.specialist(F.col("specialty")))
    if paid is not None:
        physicians = physicians.where(F.col("received_pharma_payments") == F.lit(paid))
    if states:
        physicians = physicians.where(F.col("state").isin(list(states)))
    # Claims and cost are summed before any join, so that a repeated physician
    # multiplies neither.
    per_company = in_class.groupBy("physician_npi", "company_name").agg(
        F.sum("total_claim_count").alias("claims"), money_sum(F.col("total_drug_cost_usd")).alias("cost")
    )
    volume = per_company.groupBy("physician_npi").agg(
        F.sum("claims").alias("class_claims"), F.sum("cost").cast("decimal(24,2)").alias("class_drug_cost")
    )
    order = [F.col("class_claims").desc_nulls_last(), F.col("physician_npi").asc()]
    mark = C.paid_mark(F.col("received_pharma_payments")).alias("paid")
    who = physicians.select("physician_npi", "physician_display_id", "specialty", "state", mark)
    leaders = top_ranked(volume.join(who, "physician_npi"), order, n, "rank")
    # From here on there are n rows: the bridge is only searched for their
    # physicians, not shuffled. There are no more companies than lookup rows.
    few = n <= warehouse.lookup_row_limit
    companies = hinted(per_company.select("company_name").distinct(), warehouse.lookup_is_small)
    payments = (
        warehouse.bridge_physician_company_payments.join(
            hinted(leaders.select("physician_npi"), few), "physician_npi", "left_semi"
        )
        .join(companies, "company_name", "left_semi")
        .groupBy("physician_npi")
        .agg(F.sum("total_payment_usd").alias("paid_usd"))
    )
    return (
        leaders.join(payments, "physician_npi", "left")
        .select(
            "rank",
            "physician_display_id",
            "specialty",
            "state",
            "class_claims",
            "class_drug_cost",
            F.coalesce("paid_usd", F.lit(0)).alias("total_payments_usd"),
            "paid",
        )
        .orderBy("rank")
    )


def kol_points(kols: DataFrame) -> DataFrame:
    """Key prescribers with payments, for a plot of volume over payments."""
    return kols.where(F.col("total_payments_usd") > 0)


def _dollars(column: str) -> Column:
    return F.concat(F.lit("$"), F.format_number(column, 0)).alias(column)


def kol_display_table(kols: DataFrame) -> DataFrame:
    """The same rows with counts and dollars written out."""
    return kols.select(
        "rank",
        "physician_display_id",
        "specialty",
        "state",
        F.format_number("class_claims", 0).alias("class_claims"),
        _dollars("class_drug_cost"),
        _dollars("total_payments_usd"),
        "paid",
    )


# --- one company ----------------------------------------------------------


def company_options(warehouse: Warehouse) -> DataFrame:
    per_company = _paid(warehouse.bridge_physician_company_payments, "company_name").select(
        "company_name", scaled(F.col("spend"), MILLION, 1).alias("total_m")
    )
    label = F.concat("display_name", F.lit(" ($"), F.col("total_m").cast("string"), F.lit("M)"))
    return (
        _display_names(warehouse, per_company, "display_name")
        .withColumn("label", label)
        .orderBy(F.desc("total_m"), "company_name")
    )


def company_kpis(warehouse: Warehouse, company: str) -> DataFrame:
    return (
        _pairs_of_company(warehouse, company)
        .agg(
            F.sum("total_payment_usd").cast("decimal(24,2)").alias("total_spend"),
            F.coalesce(F.sum("payment_count"), F.lit(0)).alias("n_payments"),
            F.countDistinct("physician_npi").alias("physicians_paid"),
        )
        .withColumn(
            "avg_payment",
            F.try_divide(F.col("total_spend").cast("double"), F.col("n_payments").cast("double")),
        )
    )


def company_specialty_mix(warehouse: Warehouse, company: str, top: int = 10) -> DataFrame:
    return (
        _spend_by_specialty(warehouse, _pairs_of_company(warehouse, company))
        .select("specialty", scaled(F.col("spend"), THOUSAND, 1).alias("spend_k"))
        .orderBy(F.desc("spend_k"), "specialty")
        .limit(top)
    )


def company_category_mix(warehouse: Warehouse, company: str) -> DataFrame:
    return (
        _spend(_of_company(warehouse, company), "payment_category")
        .select("payment_category", scaled(F.col("spend"), THOUSAND, 1).alias("spend_k"))
        .orderBy(F.desc("spend_k"), "payment_category")
    )


def company_geography(warehouse: Warehouse, company: str) -> DataFrame:
    return (
        analyses.payments_by_state(_of_company(warehouse, company))
        .select(
            "state",
            scaled(F.col("state_payment_usd"), THOUSAND, 1).alias("spend_k"),
            F.col("paid_physicians").alias("physicians"),
        )
        .orderBy(F.desc("spend_k"), "state")
    )


def company_top_physicians(
    warehouse: Warehouse, company: str, top: int = 25, by_npi: bool = False
) -> DataFrame:
    """Who a company paid most. Rows go by public label, specialty and state,
    which merges physicians who share all three; ``by_npi`` keeps them apart."""
    # The bridge has one row for a physician and company.
    per_physician = _pairs_of_company(warehouse, company).select(
        "physician_npi",
        F.col("total_payment_usd").alias("total_paid"),
        "payment_count",
        F.col("max_single_payment_usd").alias("largest_single"),
    )
    shown = ["physician_display_id", "specialty", "state"]
    who = warehouse.dim_physician.select("physician_npi", *shown)
    paid = per_physician.join(who, "physician_npi")
    if by_npi:
        return paid.orderBy(F.desc("total_paid"), "physician_npi").limit(top)
    return (
        paid.groupBy(*shown)
        .agg(
            F.sum("total_paid").alias("total_paid"),
            F.sum("payment_count").alias("payment_count"),
            F.max("largest_single").alias("largest_single"),
        )
        .orderBy(F.desc("total_paid"), *shown)
        .limit(top)
    )


def company_display_table(top_physicians: DataFrame) -> DataFrame:
    """The same rows with dollars written out."""
    return top_physicians.select(
        "physician_display_id",
        "specialty",
        "state",
        _dollars("total_paid"),
        "payment_count",
        _dollars("largest_single"),
    )


# --- payment against prescribing ------------------------------------------


def paid_rx_company_options(warehouse: Warehouse) -> DataFrame:
    """Companies with a physician whom they pay and who prescribes them."""
    both = (F.col("total_payment_usd") > 0) & (F.col("company_claim_count") > 0)
    companies = warehouse.fact_payment_prescribing.where(both).select("company_name").distinct()
    return _display_names(warehouse, companies, "display_name").orderBy(
        "display_name", "company_name"
    )


def specialty_options(warehouse: Warehouse) -> DataFrame:
    return (
        warehouse.fact_payment_prescribing.where(C.known_specialty(F.col("specialty")))
        .select("specialty")
        .distinct()
        .orderBy("specialty")
    )


def _prescribing_pairs(
    warehouse: Warehouse, company: str, specialty: str | None
) -> DataFrame:
    pairs = warehouse.fact_payment_prescribing.where(
        (F.col("company_name") == F.lit(company)) & (F.col("company_claim_count") > 0)
    )
    return pairs if specialty is None else pairs.where(F.col("specialty") == F.lit(specialty))


def payment_group_summary(
    warehouse: Warehouse, company: str, specialty: str | None = None
) -> DataFrame:
    """Paid and unpaid prescribers of one company. Physicians of unknown
    specialty count here."""
    claims, n = F.col("company_claim_count"), F.col("n")
    group = C.paid_group(F.col("total_payment_usd") > 0).alias("group_label")
    histogram = (
        _prescribing_pairs(warehouse, company, specialty)
        .groupBy(group, "company_claim_count")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        ranked_histogram(histogram, ["group_label"], "company_claim_count", "n")
        .groupBy("group_label")
        .agg(
            F.sum(n).alias("n_physicians"),
            F.round(percentile_of_ranked(0.5, "company_claim_count", "n"), 1).alias(
                "median_claims"
            ),
            F.sum(claims * n).alias("total_claims"),
        )
        .select(
            "group_label",
            "n_physicians",
            ratio(F.col("total_claims"), F.col("n_physicians"), 1).alias("avg_claims"),
            "median_claims",
            "total_claims",
        )
    )


def lift_ratio(
    warehouse: Warehouse, company: str, specialty: str | None = None
) -> DataFrame:
    """Mean claims of the paid over the unpaid, from means of one decimal;
    NULL if a group is missing or its mean is 0."""
    paid = F.col("total_payment_usd") > 0
    claims = F.col("company_claim_count")

    def mean(prefix: str):
        return ratio(F.col(f"{prefix}_claims"), F.col(f"{prefix}_n"), 1)

    return (
        _prescribing_pairs(warehouse, company, specialty)
        .agg(
            F.sum(F.when(paid, claims)).alias("paid_claims"),
            F.count_if(paid).alias("paid_n"),
            F.sum(F.when(~paid, claims)).alias("unpaid_claims"),
            F.count_if(~paid).alias("unpaid_n"),
        )
        .select(
            mean("paid").alias("avg_claims_paid"), mean("unpaid").alias("avg_claims_unpaid")
        )
        .withColumn(
            "lift_ratio",
            ratio(F.col("avg_claims_paid") * 10, F.col("avg_claims_unpaid") * 10, 2),
        )
    )


def payment_rx_points(
    warehouse: Warehouse, company: str, specialty: str | None = None
) -> DataFrame:
    return (
        _prescribing_pairs(warehouse, company, specialty)
        .where(F.col("total_payment_usd") > 0)
        .select("total_payment_usd", "company_claim_count", "specialty", "state")
    )


def payment_rx_pearson(
    warehouse: Warehouse,
    company: str,
    specialty: str | None = None,
    min_rows: int = rules.MIN_PEARSON_ROWS,
) -> DataFrame:
    """Correlation over the points; NULL below ``min_rows`` of them."""
    x = F.col("total_payment_usd").cast("double")
    y = F.col("company_claim_count").cast("double")
    return (
        payment_rx_points(warehouse, company, specialty)
        .agg(F.count(F.lit(1)).alias("n_points"), pearson_of(x, y).alias("r"))
        .select("n_points", F.round(F.when(F.col("n_points") >= min_rows, F.col("r")), 3).alias("pearson"))
    )


# --- market map -----------------------------------------------------------


def market_company_options(warehouse: Warehouse) -> DataFrame:
    companies = warehouse.bridge_physician_company_payments.select("company_name").distinct()
    return _display_names(warehouse, companies, "display_name").orderBy(
        "display_name", "company_name"
    )


def market_map(warehouse: Warehouse, company: str | None = None) -> DataFrame:
    """State shares for all companies or one. The class goes by the unrounded
    ratio, and a state without a ratio is balanced."""
    payments, prescriptions = warehouse.fact_payments, warehouse.fact_prescriptions
    if company is not None:
        payments = payments.where(F.col("company_name") == F.lit(company))
        prescriptions = prescriptions.where(F.col("company_name") == F.lit(company))
    balance = analyses.state_balance(
        analyses.payments_by_state(payments),
        analyses.prescribing_by_state(prescriptions, warehouse.dim_physician).drop(
            "prescribing_physicians"
        ),
    )
    return balance.select(
        "state",
        "state_payment_usd",
        "paid_physicians",
        "state_claim_count",
        "state_drug_cost_usd",
        "payment_share_pct",
        "prescribing_share_pct",
        F.round("raw_ratio", 3).alias("investment_ratio"),
        C.market_class(F.col("raw_ratio"), rules.BALANCED).alias("market_classification"),
    ).orderBy(F.desc("state_claim_count"), "state")


def _market_leaders(market: DataFrame, label: str, top: int) -> DataFrame:
    return (
        market.where(F.col("market_classification") == F.lit(label))
        .orderBy(F.desc("state_claim_count"), "state")
        .limit(top)
        .select("state", "investment_ratio", "payment_share_pct", "prescribing_share_pct")
    )


def under_invested(market: DataFrame, top: int = 10) -> DataFrame:
    return _market_leaders(market, rules.UNDER_INVESTED, top)


def over_invested(market: DataFrame, top: int = 10) -> DataFrame:
    return _market_leaders(market, rules.OVER_INVESTED, top)

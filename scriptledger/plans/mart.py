"""Mart models: three dimensions, three facts and the bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptledger.functions import columns as C
from scriptledger.functions import rules
from scriptledger.plans.intermediate import PAIR


def modal_state(payments: DataFrame) -> DataFrame:
    """One row per paid physician with their most frequent state; the first in
    the alphabet on a tie, NULL if no payment names one."""
    tally = payments.groupBy("physician_npi", "recipient_state").agg(
        F.count(F.lit(1)).alias("n")
    )
    state = F.col("recipient_state")
    preference = F.when(state.isNotNull(), F.struct(-F.col("n"), state))
    return tally.groupBy("physician_npi").agg(F.min_by(state, preference).alias("modal_state"))


def dim_physician(prescribers: DataFrame, payments: DataFrame) -> DataFrame:
    """Everyone who prescribes or is paid; names never leave staging.

    One outer join on the physician gives the prescribers, the payees who are
    not among them, and the paid flag. Payments are one row per physician by
    then, so a physician with very many of them costs no more than another.
    """
    known = prescribers.select(
        "physician_npi",
        "specialty",
        "state",
        "total_claim_count",
        "total_drug_cost_usd",
        "total_beneficiary_count",
        F.lit(True).alias("_prescribes"),
    )
    paid = modal_state(payments).withColumn("_paid", F.lit(True))
    prescribes = F.coalesce(F.col("_prescribes"), F.lit(False))
    claims, cost = F.col("total_claim_count"), F.col("total_drug_cost_usd")
    cost_per_claim = F.when(claims == 0, F.lit(0)).otherwise(F.round(F.try_divide(cost, claims), 2))
    return known.join(paid, "physician_npi", "full_outer").select(
        "physician_npi",
        C.display_id(F.col("physician_npi")).alias("physician_display_id"),
        F.when(prescribes, F.col("specialty"))
        .otherwise(rules.UNKNOWN_SPECIALTY)
        .alias("specialty"),
        F.when(prescribes, F.col("state")).otherwise(F.col("modal_state")).alias("state"),
        "total_claim_count",
        "total_drug_cost_usd",
        "total_beneficiary_count",
        cost_per_claim.cast("decimal(14,2)").alias("avg_cost_per_claim_usd"),
        prescribes.alias("is_part_d_prescriber"),
        F.coalesce(F.col("_paid"), F.lit(False)).alias("received_pharma_payments"),
    )


def dim_company(payments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every payer and every maker, with its portfolio if it has one."""
    companies = (
        payments.select("company_name").union(mapping.select("company_name")).distinct()
    )
    portfolio = mapping.groupBy("company_name").agg(
        F.countDistinct("drug_brand_name").alias("drugs"),
        F.array_join(F.array_sort(F.collect_set("therapeutic_class")), ", ").alias("areas"),
    )
    return companies.join(portfolio, "company_name", "left").select(
        "company_name",
        C.company_display_name(F.col("company_name")).alias("company_display_name"),
        F.coalesce("drugs", F.lit(0)).alias("drugs_in_portfolio"),
        F.coalesce("areas", F.lit(rules.NO_THERAPEUTIC_AREAS)).alias("therapeutic_areas"),
    )


def dim_drug(mapping: DataFrame) -> DataFrame:
    return mapping.select(
        C.hashed_key(F.col("drug_brand_name"), F.col("company_name")).alias("drug_key"),
        "drug_brand_name",
        "drug_generic_name",
        "company_name",
        "therapeutic_class",
    )


def fact_payments(payments: DataFrame) -> DataFrame:
    date = F.col("payment_date")
    return payments.select(
        "payment_id",
        "physician_npi",
        "company_name",
        "payment_date",
        "payment_amount_usd",
        "payment_category",
        "recipient_state",
        F.year(date).alias("payment_year"),
        F.quarter(date).alias("payment_quarter"),
        F.month(date).alias("payment_month"),
        C.size_bucket(F.col("payment_amount_usd")).alias("payment_size_bucket"),
    )


def fact_prescriptions(prescribing: DataFrame, mapping: DataFrame) -> DataFrame:
    """Prescribing rows with the maker and class of their brand.

    Rows of unmapped brands drop, and a brand with two makers gives a row for
    each. ``mapping`` carries the broadcast hint, if its size allows one.
    """
    makers = mapping.select("drug_brand_name_upper", "company_name", "therapeutic_class")
    brand = C.key_text(F.col("drug_brand_name"))
    return prescribing.join(makers, brand == F.col("drug_brand_name_upper")).select(
        "physician_npi",
        "drug_brand_name",
        "company_name",
        "therapeutic_class",
        "total_claim_count",
        "total_drug_cost_usd",
    )


def fact_payment_prescribing(
    paid: DataFrame, prescribed: DataFrame, physicians: DataFrame
) -> DataFrame:
    """Every pair that is paid, prescribing, or both. ``prescribed`` has the
    totals without the list of brands.

    Both inputs come out of an aggregate on the pair, so the outer join reuses
    their partitioning, and a hot physician or company has one row per pair.
    """
    payment, claims = F.col("total_payment_usd"), F.col("company_claim_count")

    def or_zero(*names: str) -> list:
        return [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in names]

    pairs = (
        paid.select(*PAIR, "total_payment_usd", "payment_count", "max_single_payment_usd")
        .join(prescribed, PAIR, "full_outer")
        .select(
            *PAIR,
            *or_zero(
                "total_payment_usd",
                "payment_count",
                "max_single_payment_usd",
                "company_claim_count",
                "company_drug_cost_usd",
                "distinct_drugs_prescribed",
            ),
            C.relationship_type(payment, claims).alias("relationship_type"),
        )
    )
    who = physicians.select("physician_npi", "specialty", "state")
    return pairs.join(who, "physician_npi", "left")


def bridge_physician_company_payments(paid: DataFrame) -> DataFrame:
    return paid.select(
        *PAIR, "total_payment_usd", "payment_count", "max_single_payment_usd"
    )

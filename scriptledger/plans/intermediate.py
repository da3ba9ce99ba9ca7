"""Intermediate models: the lookup, and both sides at physician x company."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptledger.functions import columns as C
from scriptledger.functions import rules
from scriptledger.functions.ratios import money_sum

PAIR = ["physician_npi", "company_name"]


def int_drug_company_mapping(seed: DataFrame) -> DataFrame:
    return seed.select(
        C.key_text(F.col("drug_brand_name")).alias("drug_brand_name_upper"),
        F.trim("drug_brand_name").alias("drug_brand_name"),
        F.trim("drug_generic_name").alias("drug_generic_name"),
        C.key_text(F.col("manufacturer_canonical")).alias("company_name"),
        "therapeutic_class",
    )


def int_physician_payments_agg(payments: DataFrame) -> DataFrame:
    """Totals per pair, with spend by category as columns. A category with no
    payment is NULL, not 0."""
    amount, category = F.col("payment_amount_usd"), F.col("payment_category")
    spend = [
        money_sum(F.when(category.isin(names), amount)).alias(column)
        for column, names in rules.SPEND_COLUMNS.items()
    ]
    return payments.groupBy(*PAIR).agg(
        money_sum(amount).alias("total_payment_usd"),
        F.count(F.lit(1)).alias("payment_count"),
        *spend,
        F.max(amount).alias("max_single_payment_usd"),
        F.min("payment_date").alias("first_payment_date"),
        F.max("payment_date").alias("last_payment_date"),
    )


def prescribing_totals(attributed: DataFrame) -> DataFrame:
    """Claims, cost and number of brands per pair, from prescribing rows that
    already carry the maker of their brand."""
    return attributed.groupBy(*PAIR).agg(
        F.sum("total_claim_count").alias("company_claim_count"),
        money_sum(F.col("total_drug_cost_usd")).alias("company_drug_cost_usd"),
        F.countDistinct("drug_brand_name").alias("distinct_drugs_prescribed"),
    )


def int_physician_drug_prescribing(attributed: DataFrame) -> DataFrame:
    """The same totals with the names of the brands.

    The set of brands of a pair is bounded by the lookup, and collecting it
    once serves both the count and the list. Where the list is not wanted,
    ``prescribing_totals`` does with hash aggregates alone.
    """
    per_pair = attributed.groupBy(*PAIR).agg(
        F.sum("total_claim_count").alias("company_claim_count"),
        money_sum(F.col("total_drug_cost_usd")).alias("company_drug_cost_usd"),
        F.collect_set("drug_brand_name").alias("_brands"),
    )
    return per_pair.select(
        *PAIR,
        "company_claim_count",
        "company_drug_cost_usd",
        F.size("_brands").cast("bigint").alias("distinct_drugs_prescribed"),
        F.array_join(F.array_sort("_brands"), ", ").alias("drugs_prescribed_list"),
    )

"""Staging models: one per raw table; clean, cast and canonicalise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptledger.functions import columns as C
from scriptledger.functions import rules
from scriptledger.operators.distinct_rules import NameLimit, with_rule


def stg_open_payments(raw: DataFrame, names: NameLimit | None = None) -> DataFrame:
    """Payments of at least a dollar with a recipient and a payer.

    The key hashes the raw values, so two spellings of one payer differ in it;
    equal payments on one day share it. ``names``: apply the rules once per distinct
    name, within this limit.
    """
    kept = raw.where(
        F.col("physician_npi").isNotNull()
        & F.col("company_name").isNotNull()
        & (F.col("payment_amount_usd") >= F.lit(rules.MIN_STAGED_PAYMENT_USD))
    )
    amount = F.col("payment_amount_usd").cast("decimal(14,2)")
    kept = kept.withColumn("_payer", C.key_text(F.col("company_name")))
    kept = with_rule(kept, "_payer", C.canonical_company, "_company", names)
    kept = with_rule(kept, "payment_nature", C.payment_category, "_category", names)
    return kept.select(
        C.hashed_key(
            F.col("physician_npi"),
            F.col("company_name"),
            F.col("payment_date"),
            F.col("payment_amount_usd"),
            F.col("payment_nature"),
        ).alias("payment_id"),
        C.npi(F.col("physician_npi")).alias("physician_npi"),
        F.col("_company").alias("company_name"),
        amount.alias("payment_amount_usd"),
        F.col("payment_date").cast("date").alias("payment_date"),
        F.col("_category").alias("payment_category"),
        C.key_text(F.col("recipient_state")).alias("recipient_state"),
    )


def stg_part_d_prescribers(raw: DataFrame, names: NameLimit | None = None) -> DataFrame:
    kept = with_rule(raw.where(F.col("physician_npi").isNotNull()), "specialty", C.canonical_specialty, "_specialty", names)
    return kept.select(
        C.npi(F.col("physician_npi")).alias("physician_npi"),
        F.trim("provider_first_name").alias("provider_first_name"),
        F.trim("provider_last_name").alias("provider_last_name"),
        F.col("_specialty").alias("specialty"),
        C.key_text(F.col("state")).alias("state"),
        C.whole_number(F.col("total_claim_count")).alias("total_claim_count"),
        C.money(F.col("total_drug_cost_usd")).alias("total_drug_cost_usd"),
        C.whole_number(F.col("total_beneficiary_count")).alias("total_beneficiary_count"),
    )


def stg_part_d_by_drug(raw: DataFrame) -> DataFrame:
    kept = raw.where(
        F.col("physician_npi").isNotNull() & F.col("drug_brand_name").isNotNull()
    )
    return kept.select(
        C.npi(F.col("physician_npi")).alias("physician_npi"),
        F.trim("drug_brand_name").alias("drug_brand_name"),
        F.trim("drug_generic_name").alias("drug_generic_name"),
        C.whole_number(F.col("total_claim_count")).alias("total_claim_count"),
        C.money(F.col("total_drug_cost_usd")).alias("total_drug_cost_usd"),
    )

"""Load filters: all-text frames in, typed raw tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptledger.functions import columns as C
from scriptledger.functions import rules

_WHITE_SPACE = " \t\n\r\f\v"


def load_open_payments(
    text: DataFrame,
    min_payment: float | None = rules.MIN_PAYMENT_USD,
    prefixes: Sequence[str] | None = rules.LOAD_COMPANY_PREFIXES,
) -> DataFrame:
    """Payments by tracked companies of at least ``min_payment`` dollars; ``None``
    keeps payments of any company, or any amount.

    Names are upper-cased but not trimmed here, unlike in staging.
    """
    company = F.upper(F.coalesce(F.col("company_name"), F.lit("")))
    amount = C.lenient_number(F.col("payment_amount_usd"))
    return (
        text.where(F.lit(True) if prefixes is None else C.starts_with_any(company, prefixes))
        .withColumn("payment_amount_usd", amount)
        .na.drop(subset=["physician_npi", "company_name", "payment_amount_usd"])
        .where(F.lit(True) if min_payment is None else F.col("payment_amount_usd") >= F.lit(min_payment))
        .select(
            "physician_npi",
            "company_name",
            F.col("payment_amount_usd").cast("decimal(14,2)").alias("payment_amount_usd"),
            C.lenient_date(F.col("payment_date")).alias("payment_date"),
            "payment_nature",
            "recipient_state",
        )
    )


def load_part_d_prescribers(
    text: DataFrame,
    min_claims: int | None = rules.MIN_TOTAL_CLAIMS,
    fragments: Sequence[str] | None = rules.LOAD_SPECIALTY_FRAGMENTS,
) -> DataFrame:
    """Prescribers in tracked specialties with at least ``min_claims`` claims;
    ``None`` keeps those of any specialty, or any number of claims."""
    return (
        text.where(F.lit(True) if fragments is None else C.contains_any(F.lower(F.col("specialty")), fragments))
        .withColumn("total_claim_count", C.lenient_count(F.col("total_claim_count")))
        .na.drop(subset=["physician_npi", "total_claim_count"])
        .where(F.lit(True) if min_claims is None else F.col("total_claim_count") >= F.lit(min_claims))
        .select(
            "physician_npi",
            "provider_first_name",
            "provider_last_name",
            "specialty",
            "state",
            "total_claim_count",
            C.lenient_number(F.col("total_drug_cost_usd"))
            .cast("decimal(14,2)")
            .alias("total_drug_cost_usd"),
            C.lenient_count(F.col("total_beneficiary_count")).alias(
                "total_beneficiary_count"
            ),
        )
    )


def load_part_d_by_drug(text: DataFrame, tracked: DataFrame) -> DataFrame:
    """Rows whose brand is in ``tracked`` (a lookup frame with a
    ``drug_brand_name`` column, hinted for broadcast by whoever measured it)."""
    brand = F.btrim(F.upper("drug_brand_name"), F.lit(_WHITE_SPACE))
    wanted = tracked.select(F.upper("drug_brand_name").alias("_brand"))
    return (
        text.join(wanted, brand == F.col("_brand"), "left_semi")
        .withColumn("total_claim_count", C.lenient_count(F.col("total_claim_count")))
        .na.drop(subset=["physician_npi", "drug_brand_name", "total_claim_count"])
        .select(
            "physician_npi",
            "drug_brand_name",
            "drug_generic_name",
            "total_claim_count",
            C.lenient_number(F.col("total_drug_cost_usd"))
            .cast("decimal(14,2)")
            .alias("total_drug_cost_usd"),
        )
    )

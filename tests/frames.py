"""Hand-written raw tables and marts."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from scriptledger import schemas
from scriptledger.plans.warehouse import Warehouse


def payments(spark, *rows):
    """(npi, company, amount, nature, state), all on one day."""
    filled = [
        (npi, company, Decimal(str(amount)), date(2022, 3, 4), nature, state)
        for npi, company, amount, nature, state in rows
    ]
    return spark.createDataFrame(filled, schemas.OPEN_PAYMENTS)


def prescribers(spark, *rows):
    """(npi, specialty, state, claims, cost, beneficiaries), counts as text."""
    filled = [(npi, "First", "Last", *rest) for npi, *rest in rows]
    return spark.createDataFrame(
        filled,
        "physician_npi string, provider_first_name string, provider_last_name string,"
        " specialty string, state string, total_claim_count string,"
        " total_drug_cost_usd string, total_beneficiary_count string",
    )


def by_drug(spark, *rows):
    """(npi, brand, generic, claims, cost)."""
    filled = [
        (npi, brand, generic, claims, None if cost is None else Decimal(str(cost)))
        for npi, brand, generic, claims, cost in rows
    ]
    return spark.createDataFrame(filled, schemas.PART_D_BY_DRUG)


def seed(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.DRUG_SEED)


def warehouse(spark, paid=(), who=(), drugs=(), lookup=(), **options) -> Warehouse:
    return Warehouse(
        {
            "open_payments": payments(spark, *paid),
            "part_d_prescribers": prescribers(spark, *who),
            "part_d_by_drug": by_drug(spark, *drugs),
            "drug_company_seed": seed(spark, *lookup),
        },
        **options,
    )


def rows(frame, *columns):
    chosen = frame.select(*columns) if columns else frame
    return sorted((tuple(row) for row in chosen.collect()), key=repr)

"""Declared schemas. Nothing is inferred: inference would turn identifiers
with leading zeros into numbers."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)

# Source file header -> column name, in file-independent order.
OPEN_PAYMENTS_HEADER = {
    "Covered_Recipient_NPI": "physician_npi",
    "Applicable_Manufacturer_or_Applicable_GPO_Making_Payment_Name": "company_name",
    "Total_Amount_of_Payment_USDollars": "payment_amount_usd",
    "Date_of_Payment": "payment_date",
    "Nature_of_Payment_or_Transfer_of_Value": "payment_nature",
    "Recipient_State": "recipient_state",
}
PRESCRIBERS_HEADER = {
    "Prscrbr_NPI": "physician_npi",
    "Prscrbr_First_Name": "provider_first_name",
    "Prscrbr_Last_Org_Name": "provider_last_name",
    "Prscrbr_Type": "specialty",
    "Prscrbr_State_Abrvtn": "state",
    "Tot_Clms": "total_claim_count",
    "Tot_Drug_Cst": "total_drug_cost_usd",
    "Tot_Benes": "total_beneficiary_count",
}
BY_DRUG_HEADER = {
    "Prscrbr_NPI": "physician_npi",
    "Brnd_Name": "drug_brand_name",
    "Gnrc_Name": "drug_generic_name",
    "Tot_Clms": "total_claim_count",
    "Tot_Drug_Cst": "total_drug_cost_usd",
}


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_text, _int = T.StringType(), T.IntegerType()

OPEN_PAYMENTS = _struct(
    physician_npi=_text,
    company_name=_text,
    payment_amount_usd=MONEY,
    payment_date=T.DateType(),
    payment_nature=_text,
    recipient_state=_text,
)
PART_D_PRESCRIBERS = _struct(
    physician_npi=_text,
    provider_first_name=_text,
    provider_last_name=_text,
    specialty=_text,
    state=_text,
    total_claim_count=_int,
    total_drug_cost_usd=MONEY,
    total_beneficiary_count=_int,
)
PART_D_BY_DRUG = _struct(
    physician_npi=_text,
    drug_brand_name=_text,
    drug_generic_name=_text,
    total_claim_count=_int,
    total_drug_cost_usd=MONEY,
)
DRUG_SEED = _struct(
    drug_brand_name=_text,
    drug_generic_name=_text,
    manufacturer_canonical=_text,
    therapeutic_class=_text,
)
# A table written in class directories: the type of the class is declared, as
# names of directories would otherwise be guessed at.
FACT_PRESCRIPTIONS = _struct(
    physician_npi=_text,
    drug_brand_name=_text,
    company_name=_text,
    therapeutic_class=_text,
    total_claim_count=_int,
    total_drug_cost_usd=MONEY,
)

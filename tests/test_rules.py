"""Every rule once, and the pairs whose order matters."""

import pytest
from pyspark.sql import functions as F

from scriptledger.functions import columns as C


def labels(spark, build, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    return [row[0] for row in rows.select(build(F.col("v"))).collect()]


COMPANIES = {
    "Pfizer Inc": "PFIZER",
    " pfizer inc ": "PFIZER",
    "AbbVie Inc.": "ABBVIE",
    "Johnson & Johnson Health": "JOHNSON & JOHNSON",
    "Janssen Biotech": "JOHNSON & JOHNSON",
    "Novo Nordisk AS": "NOVO NORDISK",
    "Merck Sharp & Dohme": "MERCK",
    "Bristol-Myers Squibb": "BRISTOL-MYERS SQUIBB",
    "BRISTOL MYERS": "BRISTOL-MYERS SQUIBB",
    "Celgene Corp": "BRISTOL-MYERS SQUIBB",
    "BRISTOL LABS": "BRISTOL LABS",
    "Eli Lilly": "ELI LILLY",
    "Lilly USA": "ELI LILLY",
    "AstraZeneca LP": "ASTRAZENECA",
    "Novartis AG": "NOVARTIS",
    "Sanofi US": "SANOFI",
    "GSK plc": "GSK",
    "GlaxoSmithKline": "GSK",
    "Gilead Sciences": "GILEAD",
    "Amgen": "AMGEN",
    "Bayer AG": "BAYER",
    "Boehringer I": "BOEHRINGER INGELHEIM",
    "Takeda": "TAKEDA",
    "Regeneron": "REGENERON",
    "Biogen": "BIOGEN",
    "Vertex": "VERTEX",
    "Moderna TX": "MODERNA",
    "The Pfizer Foundation": "THE PFIZER FOUNDATION",
    "unknown co ": "UNKNOWN CO",
}

NATURES = {
    "Food and Beverage": "Food and Beverage",
    "food AND beverage": "Food and Beverage",
    "Travel and Lodging": "Travel and Lodging",
    "Compensation for services other than consulting, including serving as faculty or as a"
    " speaker at a venue": "Speaking Fee",
    "Compensation for serving as a speaker": "Speaking Fee",
    "Compensation for serving as faculty for a medical education program": "Speaking Fee",
    "Consulting Fee": "Consulting Fee",
    "Education": "Education",
    "Honoraria": "Honoraria",
    "Royalty or License": "Royalty / License",
    "Grant": "Grant",
    "Charitable Contribution": "Charitable Contribution",
    "Long term medical supply": "Device Loan",
    "device loan": "Device Loan",
    "Acquisitions": "Acquisition",
    "Debt forgiveness": "Debt Forgiveness",
    "Gift": "Gift",
    "Entertainment": "Entertainment",
    "Speaker without compensation": "Other",
    "consulting": "Other",
    "": "Other",
    None: "Other",
}

SPECIALTIES = {
    "Interventional Cardiology": "Cardiology",
    "Medical Oncology": "Oncology",
    "Hematology-Oncology": "Oncology",
    "Hematology": "Hematology / Oncology",
    "ENDOCRINOLOGY": "Endocrinology",
    "Rheumatology": "Rheumatology",
    "Gastroenterology": "Gastroenterology",
    "Neurology": "Neurology",
    "Urology": "Urology",
    "Psychiatry": "Psychiatry",
    "Dermatology": "Dermatology",
    "Pulmonology": "Pulmonology",
    "Nephrology": "Nephrology",
    "Infectious Disease": "Infectious Disease",
    "Family Practice": "Family Medicine",
    "Family Medicine": "Family Medicine",
    "Practice of Family": "Practice of Family",
    "Internal Medicine": "Internal Medicine",
    "General Practice": "General Practice",
    "Nurse Practitioner": "Nurse Practitioner",
    "Physician Assistant": "Physician Assistant",
    " Podiatry ": "Podiatry",
    None: "Unknown",
}


@pytest.mark.parametrize(
    "build, expected",
    [
        (lambda c: C.canonical_company(C.key_text(c)), COMPANIES),
        (C.payment_category, NATURES),
        (C.canonical_specialty, SPECIALTIES),
    ],
    ids=["company", "category", "specialty"],
)
def test_each_rule(spark, build, expected):
    got = labels(spark, build, list(expected))
    assert dict(zip(expected, got, strict=True)) == expected


def test_display_names(spark):
    expected = {
        "ABBVIE": "AbbVie",
        "GSK": "GSK",
        "BRISTOL-MYERS SQUIBB": "Bristol Myers Squibb",
        "ACME-BIO LABS": "Acme-Bio Labs",
        "O'NEIL & CO": "O'Neil & Co",
        "3M HEALTH": "3m Health",
    }
    assert labels(spark, C.company_display_name, list(expected)) == list(expected.values())

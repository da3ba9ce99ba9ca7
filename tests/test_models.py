from decimal import Decimal

from frames import rows, warehouse

LOOKUP = [
    ("Alpha", "gen a", "PFIZER", "Oncology"),
    ("Beta ", "gen b", "pfizer", "Cardiology"),
    ("Gamma", "gen g", "MERCK", "Oncology"),
]


def test_staging_guards_and_colliding_keys(spark):
    w = warehouse(
        spark,
        paid=[
            ("1", "Pfizer", 0.99, "Gift", "ny"),
            ("1", "Pfizer", 1.00, "Gift", " ny"),
            ("1", "Pfizer", 1.00, "Gift", " ny"),
            (None, "Pfizer", 5, "Gift", "ny"),
            ("1", None, 5, "Gift", "ny"),
            ("1", "Pfizer Inc", 1.00, None, None),
        ],
    )
    kept = w.stg_open_payments.collect()
    assert len(kept) == 3
    assert {row.company_name for row in kept} == {"PFIZER"}
    assert {row.recipient_state for row in kept} == {"NY", None}
    assert len({row.payment_id for row in kept}) == 2


def test_spend_columns_are_null_without_payments(spark):
    w = warehouse(
        spark,
        paid=[
            ("1", "Pfizer", 10, "Gift", "NY"),
            ("1", "Pfizer", 20, "Consulting Fee", "NY"),
            ("1", "Pfizer", 5, "something else", "NY"),
        ],
    )
    row = w.int_physician_payments_agg.first()
    assert row.total_payment_usd == Decimal("35.00")
    assert row.payment_count == 3
    assert row.spend_other_usd == Decimal("15.00")
    assert row.spend_consulting_usd == Decimal("20.00")
    assert row.spend_education_usd is None
    assert row.max_single_payment_usd == Decimal("20.00")


def test_drug_join_ignores_case_and_drops_unmapped(spark):
    w = warehouse(
        spark,
        drugs=[
            ("1", "ALPHA ", "gen a", 5, 1),
            ("1", "alpha", "gen a2", 6, 2),
            ("1", "Beta", "gen b", 7, 3),
            ("1", "Unmapped", "x", 100, 100),
            (None, "Alpha", "x", 100, 100),
        ],
        lookup=LOOKUP,
    )
    assert rows(w.int_physician_drug_prescribing) == [
        ("0000000001", "PFIZER", 18, Decimal("6.00"), 3, "ALPHA, Beta, alpha")
    ]
    assert w.fact_prescriptions.count() == 3


def test_a_brand_with_two_makers_counts_for_both(spark):
    w = warehouse(
        spark,
        drugs=[("1", "Alpha", "g", 5, 1)],
        lookup=[*LOOKUP, ("Alpha", "gen a", "BAYER", "Oncology")],
    )
    got = rows(w.int_physician_drug_prescribing, "company_name", "company_claim_count")
    assert got == [("BAYER", 5), ("PFIZER", 5)]


def test_physicians_of_both_sources(spark):
    w = warehouse(
        spark,
        paid=[
            ("1", "Pfizer", 10, "Gift", "CA"),
            ("2", "Pfizer", 10, "Gift", "TX"),
            ("2", "Pfizer", 11, "Gift", "NY"),
            ("2", "Pfizer", 12, "Gift", None),
            ("3", "Pfizer", 10, "Gift", None),
        ],
        who=[
            ("1", "Urology", "ny", "0", "50.00", "*"),
            ("4", "Urology", "ny", "4", "50.02", "3"),
            ("5", None, None, "*", "50.00", None),
        ],
    )
    got = rows(
        w.dim_physician,
        "physician_npi",
        "specialty",
        "state",
        "total_claim_count",
        "avg_cost_per_claim_usd",
        "is_part_d_prescriber",
        "received_pharma_payments",
    )
    assert got == [
        ("0000000001", "Urology", "NY", 0, Decimal("0.00"), True, True),
        # two states tie: the first in the alphabet; NULL never wins
        ("0000000002", "Unknown", "NY", None, None, False, True),
        ("0000000003", "Unknown", None, None, None, False, True),
        # 50.02 / 4 = 12.505
        ("0000000004", "Urology", "NY", 4, Decimal("12.51"), True, False),
        ("0000000005", "Unknown", None, None, None, True, False),
    ]


def test_names_stay_in_staging(small):
    for model in (small.dim_physician, small.fact_payment_prescribing, small.fact_payments):
        assert not [name for name in model.columns if "first_name" in name or "last_name" in name]


def test_four_kinds_of_pair(spark):
    w = warehouse(
        spark,
        paid=[("1", "Pfizer", 10, "Gift", "CA"), ("2", "Merck", 10, "Gift", "CA")],
        who=[("1", "Urology", "ny", "9", "1", "1")],
        drugs=[
            ("1", "Alpha", "g", 5, 1),
            ("3", "Gamma", "g", 6, 1),
            ("4", "Gamma", "g", None, 1),
        ],
        lookup=LOOKUP,
    )
    got = rows(
        w.fact_payment_prescribing,
        "physician_npi",
        "company_name",
        "total_payment_usd",
        "company_claim_count",
        "relationship_type",
        "specialty",
    )
    assert got == [
        ("0000000001", "PFIZER", Decimal("10.00"), 5, "paid_and_prescribed", "Urology"),
        ("0000000002", "MERCK", Decimal("10.00"), 0, "paid_no_rx", "Unknown"),
        ("0000000003", "MERCK", Decimal("0.00"), 6, "rx_no_payment", None),
        ("0000000004", "MERCK", Decimal("0.00"), 0, "neither", None),
    ]


def test_companies_of_either_source(spark):
    w = warehouse(spark, paid=[("1", "Acme-bio", 10, "Gift", "CA")], lookup=LOOKUP)
    assert rows(w.dim_company) == [
        ("ACME-BIO", "Acme-Bio", 0, "N/A"),
        ("MERCK", "Merck", 1, "Oncology"),
        ("PFIZER", "Pfizer", 2, "Cardiology, Oncology"),
    ]


def test_empty_inputs(spark):
    w = warehouse(spark)
    assert w.fact_payment_prescribing.count() == 0
    assert w.dim_physician.count() == 0
    assert w.dim_company.count() == 0

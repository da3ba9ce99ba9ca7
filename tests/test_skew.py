"""One physician, payer, brand, class, specialty and state hold a third or
more of all rows. Results must be whole, and equal to the plain statements."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from comparing import difference, oracle_connection
from conftest import SMALL

import duckdb_statements
from frames import prescribers, seed
from scriptledger import registry, schemas
from scriptledger.plans.warehouse import RAW, Warehouse
from scriptledger.sources import driver_tables as given


def mostly(first, others):
    """``first`` about a third of the time."""
    return first if random.random() < 0.34 else random.choice(others)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    random.seed(11)
    npis = [str(n) for n in range(2, 260)]
    paid = [
        (
            mostly("1", npis),
            mostly("Pfizer Inc", given.PAYERS),
            Decimal(random.randint(50, 9_999_999)) / 100,
            date(2022, 1, 1) + timedelta(days=random.randrange(300)),
            mostly("Gift", given.NATURES),
            mostly("as", ["bs", "cs", "FOR", None]),
        )
        for _ in range(6000)
    ]
    drugs = [
        (
            mostly("1", npis),
            mostly("Drug 0", [f"Drug {d} " for d in range(64)]),
            "generic",
            random.choice([None, 1, 2, 15, 40, 900]),
            Decimal(random.randint(0, 999_999)) / 100,
        )
        for _ in range(6000)
    ]
    who = [
        (
            npi,
            mostly("Cardiology", given.SPECIALTIES),
            mostly("as", ["bs", "cs", None]),
            random.choice(["*", "12", "900"]),
            "100.05",
            random.choice(["*", "3"]),
        )
        for npi in ["1", *npis]
        if random.random() < 0.8 or npi == "1"
    ]
    lookup = [
        (f"Drug {d}", "g", mostly("PFIZER", ["MERCK", "GSK", "ACME"]), mostly("Oncology", ["Cardiology", "Neurology"]))
        for d in range(60)
    ]
    tables = {
        "open_payments": spark.createDataFrame(paid, schemas.OPEN_PAYMENTS),
        "part_d_prescribers": prescribers(spark, *who),
        "part_d_by_drug": spark.createDataFrame(drugs, schemas.PART_D_BY_DRUG),
        "drug_company_seed": seed(spark, *lookup),
    }
    folder = str(tmp_path_factory.mktemp("hot"))
    connection = oracle_connection(SMALL)
    for name, frame in tables.items():
        frame.repartition(5).write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
        connection.execute(f"CREATE VIEW {name} AS FROM read_parquet('{folder}/{name}/*.parquet')")
    return Warehouse(tables), connection


COMPARED = [
    "int_physician_payments_agg",
    "int_physician_drug_prescribing",
    "dim_physician",
    "dim_company",
    "fact_prescriptions",
    "fact_payment_prescribing",
    "kol_identification",
    "payment_prescribing_correlation_min3",
    "company_spend_efficiency",
    "geographic_market_analysis",
    "physician_loyalty_scoring",
    "dashboard_kpis",
    "spend_by_company",
    "spend_by_specialty",
    "kol_finder",
    "kol_finder_unpaid",
    "company_geography",
    "company_top_physicians_by_npi",
    "payment_group_summary",
    "payment_rx_pearson",
    "market_map_company",
    "dq_relationships",
    "dq_unique",
    "dq_report",
]


@pytest.mark.parametrize("name", COMPARED)
def test_hot_keys(hot, name):
    warehouse, connection = hot
    frame = registry.plain_numbers(registry.BUILDERS[name](warehouse))
    assert difference(frame, connection, duckdb_statements.statements(given=RAW)[name]) is None


@pytest.mark.parametrize(
    "name", ["fact_prescriptions", "kol_identification", "kol_finder", "physician_loyalty_scoring"]
)
def test_hot_keys_with_a_lookup_too_large_to_broadcast(hot, name):
    warehouse, connection = hot
    raw = {table: warehouse.table(table) for table in RAW}
    shuffled = Warehouse(raw, lookup_row_limit=3)
    frame = registry.plain_numbers(registry.BUILDERS[name](shuffled))
    assert difference(frame, connection, duckdb_statements.statements(given=RAW)[name]) is None


def test_the_hot_keys_are_hot(hot):
    warehouse, _ = hot
    payments = warehouse.stg_open_payments
    total = payments.count()
    assert payments.where("physician_npi = '0000000001'").count() > total / 3.2
    assert payments.where("company_name = 'PFIZER'").count() > total / 3.2

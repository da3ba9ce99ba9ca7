"""Adapter: order, customer, line-item and part tables -> the raw tables.

Used by the registered queries, the tests and the bench, which have no real
extracts. Every rule is integer or exact decimal arithmetic on the given rows,
so the raw tables grow with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptledger.functions import columns as C
from scriptledger.functions import rules

# Raw payer names, by position.
PAYERS = [
    "Pfizer Inc",
    " abbvie inc",
    "Janssen Biotech, Inc.",
    "Merck Sharp & Dohme LLC",
    "Celgene Corporation",
    "Lilly USA, LLC",
    "NOVO NORDISK AS",
    "AstraZeneca Pharmaceuticals LP",
    "Novartis Pharma AG",
    "Amgen Inc.",
    "Sanofi US",
    "GlaxoSmithKline",
    "Gilead Sciences",
    "Bayer AG",
    "Boehringer Ingelheim",
    "Takeda Pharma",
    "Regeneron Inc",
    "Biogen Inc",
    "Vertex Inc",
    "Moderna TX",
    "Bristol-Myers Squibb Co",
    "Johnson & Johnson",
    "Eli Lilly and Company",
    "Acme-Bio labs",
    "Umbra health",
]

# Raw nature-of-payment texts, by position.
NATURES = [
    "Food and Beverage",
    "Travel and Lodging",
    "Compensation for services other than consulting, including serving as faculty or as a speaker at a venue other than a continuing education program",
    "Compensation for serving as faculty or as a speaker for a medical education program",
    "Consulting Fee",
    "Education",
    "Honoraria",
    "Royalty or License",
    "Grant",
    "Charitable Contribution",
    "Long term medical supply or device loan",
    "Acquisitions",
    "Debt forgiveness",
    "Gift",
    "Entertainment",
    "Current or prospective ownership or investment interest",
    "FOOD AND BEVERAGE",
    None,
]

# Raw specialties; the first five belong to the five market
# segments in alphabetical order.
SPECIALTIES = [
    "Interventional Cardiology",
    "Medical Oncology",
    "Endocrinology",
    "Internal Medicine",
    "Nurse Practitioner",
    "Hematology-Oncology",
    "Hematology",
    "Rheumatology",
    "Gastroenterology",
    "Neurology",
    "Psychiatry & Neuro",
    "Dermatology",
    "Pulmonology",
    "Nephrology",
    "Urology",
    "Infectious Disease",
    "Family Practice",
    "General Practice",
    "Physician Assistant",
    None,
]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

BRANDS = 64
MAPPED_BRANDS = 60


def _pick(options: Sequence[str | None], index: Column) -> Column:
    """Element ``index`` (from 0) of a literal list."""
    return F.get(F.array(*[F.lit(option) for option in options]), index.cast("int"))


def _state(nation: Column) -> Column:
    return (
        F.when(nation == 24, F.lit(None).cast("string"))
        .when(nation == 23, "FOR")
        .otherwise(F.concat(F.char(nation + 65), F.lit("s")))
    )


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _physician(key: Column, apart: Column, offset: int) -> Column:
    """The key as a physician number; where ``apart`` holds, of another physician,
    who has a number above ``offset`` and stands in this raw table only."""
    key = key.cast("bigint")
    return F.when(apart, key + F.lit(offset)).otherwise(key).cast("string")


# Offsets of the physicians that one raw table alone knows.
PAID_ONLY, PRESCRIBER_ONLY, BY_DRUG_ONLY = 9_000_000_000, 8_000_000_000, 7_000_000_000


def open_payments(spark: SparkSession, directory: str) -> DataFrame:
    orders = _table(spark, directory, "orders")
    customers = _table(spark, directory, "customer").select("c_custkey", "c_nationkey")
    order, buyer, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    rounded = F.round(price).cast("bigint")
    amount = (
        F.when(order % 101 == 0, price.cast("decimal(14,2)"))
        .when(order % 53 == 0, F.lit("0.50").cast("decimal(14,2)"))
        .otherwise((rounded / F.lit(100.0)).cast("decimal(14,2)"))
    )
    return (
        orders.join(customers, buyer == F.col("c_custkey"))
        .select(
            _physician(buyer, buyer % 10 == 0, PAID_ONLY).alias("physician_npi"),
            _pick(PAYERS, (order * 7 + buyer) % len(PAYERS)).alias("company_name"),
            amount.alias("payment_amount_usd"),
            F.to_date("o_orderdate").alias("payment_date"),
            _pick(NATURES, order % len(NATURES)).alias("payment_nature"),
            _state(F.col("c_nationkey")).alias("recipient_state"),
        )
    )


def part_d_prescribers(spark: SparkSession, directory: str) -> DataFrame:
    key = F.col("c_custkey")
    claims = 5 + (key * 37) % 3000
    common = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1
    rare = 5 + F.floor(key / 10) % 15
    return (
        _table(spark, directory, "customer")
        .select(
            _physician(key, (key % 10 == 3) | (key % 20 == 0), PRESCRIBER_ONLY).alias("physician_npi"),
            F.concat(F.lit("F"), key.cast("string")).alias("provider_first_name"),
            F.col("c_name").alias("provider_last_name"),
            _pick(SPECIALTIES, F.when(key % 10 < 8, common).otherwise(rare)).alias(
                "specialty"
            ),
            _state(F.col("c_nationkey")).alias("state"),
            F.when(key % 13 == 0, "*")
            .otherwise(claims.cast("string"))
            .alias("total_claim_count"),
            (F.abs("c_acctbal").cast("decimal(14,2)") * 10)
            .cast("decimal(14,2)")
            .alias("total_drug_cost_usd"),
            F.when(key % 11 != 0, F.floor(claims / 3).cast("int")).alias(
                "total_beneficiary_count"
            ),
        )
    )


def part_d_by_drug(spark: SparkSession, directory: str) -> DataFrame:
    buyers = _table(spark, directory, "orders").select("o_orderkey", "o_custkey")
    sold = (
        _table(spark, directory, "lineitem")
        .join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", (F.col("l_partkey") % BRANDS).alias("d"))
        .agg(
            F.sum("l_quantity").cast("int").alias("claims"),
            F.sum(F.col("l_extendedprice").cast("decimal(14,2)"))
            .cast("decimal(14,2)")
            .alias("cost"),
        )
    )
    brand = F.concat(F.lit("Drug "), F.col("d").cast("string"))
    return sold.select(
        _physician(F.col("o_custkey"), F.col("o_custkey") % 7 == 0, BY_DRUG_ONLY).alias("physician_npi"),
        F.when(F.col("d") % 3 == 0, F.concat(F.upper(brand), F.lit(" ")))
        .otherwise(brand)
        .alias("drug_brand_name"),
        F.concat(F.lit("generic "), F.floor(F.col("d") / 2).cast("string")).alias(
            "drug_generic_name"
        ),
        F.col("claims").alias("total_claim_count"),
        F.col("cost").alias("total_drug_cost_usd"),
    )


def drug_seed(spark: SparkSession, directory: str) -> DataFrame:
    """Brands found in the part table; the last few stay unmapped."""
    d = F.col("d")
    payer = C.key_text(_pick(PAYERS, d % len(PAYERS)))
    return (
        _table(spark, directory, "part")
        .select((F.col("p_partkey") % BRANDS).alias("d"))
        .where(d < MAPPED_BRANDS)
        .distinct()
        .withColumn("payer", payer)
        .select(
            F.concat(F.lit("Drug "), d.cast("string")).alias("drug_brand_name"),
            F.concat(F.lit("generic "), F.floor(d / 2).cast("string")).alias(
                "drug_generic_name"
            ),
            C.canonical_company(F.col("payer")).alias("manufacturer_canonical"),
            _pick(rules.THERAPEUTIC_CLASSES, d % len(rules.THERAPEUTIC_CLASSES)).alias(
                "therapeutic_class"
            ),
        )
    )


def as_text(frame: DataFrame, date_format: str = "MM/dd/yyyy") -> DataFrame:
    """The frame as a CSV scan would give it: every column a string."""
    return frame.select(
        [
            (
                F.date_format(name, date_format) if kind == "date" else F.col(name).cast("string")
            ).alias(name)
            for name, kind in frame.dtypes
        ]
    )

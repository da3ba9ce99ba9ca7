import hashlib
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from scriptledger.functions import columns as C
from scriptledger.functions import rules
from scriptledger.functions.ratios import money_sum, percentage, ratio, scaled


def column(spark, build, values, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [row[0] for row in rows.select(build(F.col("v"))).collect()]


def test_npi(spark):
    got = column(spark, C.npi, ["123456789", "1234567890", " 12 ", "12345678901", None])
    assert got == ["0123456789", "1234567890", "0000000012", "1234567890", None]


def test_redacted_numbers(spark):
    given = ["*", "155", " 155 ", "155.0", "-5", "1.2.3", "", "12\n", "99999999999", None]
    whole = column(spark, C.whole_number, given)
    assert whole == [None, 155, 155, None, None, None, None, None, None, None]
    money = column(spark, C.money, given)
    assert money[:6] == [None, Decimal("155.00"), Decimal("155.00"), Decimal("155.00"), None, None]


def test_lenient_coercion(spark):
    assert column(spark, C.lenient_count, ["155.0", "155", "x", "", None, "1.5"]) == [
        155,
        155,
        None,
        None,
        None,
        None,
    ]
    assert column(spark, C.lenient_date, ["01/31/2022", "2022-01-31", "31/31/2022", None]) == [
        date(2022, 1, 31),
        date(2022, 1, 31),
        None,
        None,
    ]


def test_trim_leaves_tabs(spark):
    assert column(spark, C.key_text, [" a ", "\ta"]) == ["A", "\tA"]


def _with_leading_bits(bits: str) -> str:
    number = 0
    while hashlib.md5(str(number).encode()).hexdigest()[:4] != bits:
        number += 1
    return str(number)


def test_display_id_is_always_four_characters(spark):
    highest, lowest = _with_leading_bits("ffff"), _with_leading_bits("0007")
    got = column(spark, C.display_id, [highest, lowest])
    assert got == ["Physician #6553", "Physician #0007"]


def test_hashed_key_marks_nulls(spark):
    row = spark.createDataFrame([("a", None)], "x string, y string")
    got = row.select(C.hashed_key(F.col("x"), F.col("y"))).first()[0]
    assert got == hashlib.md5(f"a-{rules.KEY_NULL_TOKEN}".encode()).hexdigest()


def test_size_buckets(spark):
    amounts = ["1.00", "99.99", "100", "999.99", "1000", "9999.99", "10000", "99999.99", "100000"]
    got = column(spark, C.size_bucket, [Decimal(a) for a in amounts], "decimal(14,2)")
    assert got == [
        "< $100",
        "< $100",
        "$100 – $1K",
        "$100 – $1K",
        "$1K – $10K",
        "$1K – $10K",
        "$10K – $100K",
        "$10K – $100K",
        "> $100K",
    ]


def test_bands(spark):
    tiers = column(spark, C.kol_tier, [1.0, 0.99, 0.9899, 0.95, 0.90, 0.89], "double")
    assert [tier[0] for tier in tiers] == ["A", "A", "B", "B", "C", "D"]
    segments = column(spark, C.loyalty_segment, [9000.0, 8999.0, 5000.0, 2500.0, 2499.0], "double")
    assert segments == [
        "Loyalist (single source)",
        "Strong preference",
        "Strong preference",
        "Mixed prescriber",
        "Highly diversified",
    ]


def test_market_bounds_are_open(spark):
    ratios = [0.749, 0.75, 1.0, 1.25, 1.251, None]
    analysis = column(spark, lambda c: C.market_class(c, rules.INSUFFICIENT_DATA), ratios, "double")
    assert analysis == [
        "Under-invested",
        "Balanced",
        "Balanced",
        "Balanced",
        "Over-invested",
        "Insufficient data",
    ]
    assert column(spark, lambda c: C.market_class(c, rules.BALANCED), [None], "double") == ["Balanced"]


def test_unknown_or_missing_specialty_is_no_specialist(spark):
    given = ["Cardiology", "Unknown", "Nurse Practitioner", None]
    assert column(spark, C.specialist, given) == [True, False, False, None]
    assert column(spark, C.known_specialty, given) == [True, False, True, False]


def test_valid_state(spark):
    assert column(spark, C.valid_state, ["NY", "N", "NYC", None]) == [True, False, False, False]


def test_ratios_round_half_away_from_zero(spark):
    one = spark.range(1)
    got = one.select(
        ratio(F.lit(49), F.lit(20), 1),
        ratio(F.lit(1005), F.lit(1000), 2),
        ratio(F.lit(1), F.lit(0), 1),
        ratio(F.lit(None).cast("int"), F.lit(3), 1),
        percentage(F.lit(1), F.lit(3), 2),
        scaled(F.lit("12345000.00").cast("decimal(24,2)"), 1_000_000, 2),
    ).first()
    assert list(got) == [2.5, 1.01, None, None, 33.33, Decimal("12.35")]


def test_money_sum_is_exact(spark):
    rows = spark.createDataFrame(
        [(Decimal("999999999999.99"),), (Decimal("0.01"),), (Decimal("-0.02"),), (None,)],
        "v decimal(14,2)",
    )
    assert rows.agg(money_sum(F.col("v"))).first()[0] == Decimal("999999999999.98")
    assert rows.where("v is null").agg(money_sum(F.col("v"))).first()[0] is None

"""Rules applied once per distinct name equal rules applied to each row."""

import re

import pytest
from pyspark.sql import functions as F

from frames import rows, warehouse

from scriptledger.functions import columns as C
from scriptledger.operators.distinct_rules import NameLimit, names_fit, with_rule
from scriptledger.plans import pipeline

PAID = [
    ("1", " pfizer inc ", 10, "Food and Beverage", "ny"),
    ("1", "PFIZER INC", 11, None, "ny"),
    ("2", "Unheard-of Devices", 12, "Consulting Fee", None),
    ("3", "", 13, "", "CA"),
    ("4", None, 14, "Gift", "CA"),
] * 3
WHO = [("1", " Internal Medicine ", "NY", "5", "1.00", "2"), ("2", None, "CA", "*", None, None), ("3", "", "CA", "1", "2", "3")]
PATTERNS = r"Contains|contains|LIKE|StartsWith|EndsWith"


def both(spark, name, **limit):
    plain, mapped = (warehouse(spark, PAID, WHO, names=names) for names in (None, NameLimit(**limit)))
    return plain.table(name), mapped.table(name)


@pytest.mark.parametrize("limit", [{}, {"rows": 1}, {"rows": 0}, {"text_bytes": 3}])
@pytest.mark.parametrize("name", ["stg_open_payments", "stg_part_d_prescribers"])
def test_staging_is_the_same_by_distinct_name(spark, name, limit):
    plain, mapped = both(spark, name, **limit)
    assert mapped.schema.names == plain.schema.names
    assert rows(mapped) == rows(plain) and rows(plain)


def test_rules_stand_on_distinct_names_only(spark):
    plain, mapped = (f._jdf.queryExecution().executedPlan().toString().split("\n") for f in both(spark, "stg_open_payments"))
    # Each rule is computed in the aggregate that makes names distinct, and in no row's projection.
    grouped = [line for line in mapped if re.search(r"HashAggregate\(keys=\[_rule_name#\d+\].*_rule_outcome#\d+\]", line)]
    assert len(grouped) == 2 and sum("BroadcastExchange" in line for line in mapped) == 2
    assert not [line for line in mapped if re.search(PATTERNS, line)]
    assert [line for line in plain if re.search(PATTERNS, line)]


def test_names_are_measured_by_rows_and_bytes(spark):
    names = spark.createDataFrame([("abc",), ("de",)], "n string")
    assert names_fit(names, "n", NameLimit(2, 5))
    assert not names_fit(names, "n", NameLimit(1, 100)) and not names_fit(names, "n", NameLimit(2, 4))
    assert names_fit(names.limit(0), "n", NameLimit(0, 0))


def test_the_rule_replaces_a_column_and_keeps_the_others(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "name string, n int")
    rule = lambda c: F.coalesce(F.upper(c), F.lit("none"))
    expected = [("A", 1), ("A", 1), ("none", 2)]
    assert rows(with_rule(frame, "name", rule, "name", NameLimit())) == expected
    assert rows(with_rule(frame, "name", rule, "name")) == expected
    assert with_rule(frame.limit(0), "name", rule, "label", NameLimit()).count() == 0


def test_a_build_takes_the_limit(spark, small, tmp_path):
    small_names = type(small)({n: small.tables[n] for n in small.tables}, small.lookup_row_limit, names=NameLimit())
    plain = pipeline.build_mart(small, str(tmp_path / "plain")).warehouse
    mapped = pipeline.build_mart(small_names, str(tmp_path / "mapped")).warehouse
    for name in ("fact_payments", "dim_physician"):
        assert rows(mapped.table(name)) == rows(plain.table(name))

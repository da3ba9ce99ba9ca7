"""The declared checks of every table, and one report over all of them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scriptledger.functions import rules
from scriptledger.operators import checks
from scriptledger.plans.warehouse import Warehouse


@dataclass(frozen=True)
class Check:
    table: str
    column: str
    test: str
    arguments: dict[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}.{self.test}"


#: Tests that compare rows by a key; the others look at one row at a time.
BY_KEY = ("unique", "relationships")


def _all_not_null(table: str, *columns: str) -> list[Check]:
    return [Check(table, column, "not_null") for column in columns]


def _all_unique(**column_of: str) -> list[Check]:
    return [Check(table, column, "unique") for table, column in column_of.items()]


def _range(table: str, column: str, low: float, high: float | None = None) -> Check:
    return Check(table, column, "between", {"low": low, "high": high})


def _accepted(table: str, column: str, values: Iterable[Any]) -> Check:
    return Check(table, column, "accepted_values", {"accepted": list(values)})


def _refers(table: str, column: str, parent: str) -> Check:
    return Check(table, column, "relationships", {"parent": parent, "parent_column": column})


# What every build has to satisfy.
SUITE = [
    *_all_not_null("open_payments", "physician_npi", "company_name", "payment_amount_usd"),
    *_all_not_null("part_d_prescribers", "physician_npi", "total_claim_count"),
    *_all_not_null("part_d_by_drug", "physician_npi", "total_claim_count"),
    *_all_not_null(
        "drug_company_seed", "drug_brand_name", "manufacturer_canonical", "therapeutic_class"
    ),
    *_all_not_null(
        "stg_open_payments", "payment_id", "physician_npi", "company_name", "payment_amount_usd"
    ),
    *_all_not_null("stg_part_d_prescribers", "physician_npi", "specialty"),
    *_all_not_null("stg_part_d_by_drug", "physician_npi", "drug_brand_name"),
    *_all_not_null(
        "int_physician_payments_agg", "physician_npi", "company_name", "total_payment_usd"
    ),
    *_all_not_null("int_drug_company_mapping", "drug_brand_name_upper", "company_name"),
    *_all_not_null(
        "int_physician_drug_prescribing", "physician_npi", "company_name", "company_claim_count"
    ),
    *_all_not_null(
        "dim_physician",
        "physician_npi",
        "physician_display_id",
        "specialty",
        "is_part_d_prescriber",
        "received_pharma_payments",
    ),
    *_all_not_null("dim_company", "company_name"),
    *_all_not_null("dim_drug", "drug_key", "therapeutic_class"),
    *_all_not_null("fact_payments", "payment_id", "physician_npi", "company_name"),
    *_all_not_null("fact_prescriptions", "physician_npi"),
    *_all_not_null(
        "fact_payment_prescribing", "physician_npi", "company_name", "relationship_type"
    ),
    *_all_unique(
        part_d_prescribers="physician_npi",
        stg_part_d_prescribers="physician_npi",
        int_drug_company_mapping="drug_brand_name_upper",
        dim_physician="physician_npi",
        dim_company="company_name",
        dim_drug="drug_key",
    ),
    _range("open_payments", "payment_amount_usd", 0, 100_000_000),
    _range("stg_open_payments", "payment_amount_usd", 1),
    _range("int_physician_payments_agg", "total_payment_usd", 0),
    _accepted("drug_company_seed", "therapeutic_class", rules.THERAPEUTIC_CLASSES),
    _accepted("stg_open_payments", "payment_category", rules.CATEGORIES),
    _accepted("dim_physician", "is_part_d_prescriber", [True, False]),
    _accepted("dim_physician", "received_pharma_payments", [True, False]),
    _accepted("fact_payment_prescribing", "relationship_type", rules.RELATIONSHIP_TYPES),
    _refers("fact_payments", "physician_npi", "dim_physician"),
    _refers("fact_payments", "company_name", "dim_company"),
]


def violations(warehouse: Warehouse, check: Check) -> DataFrame:
    """The rows, values or keys that break one check."""
    rows = warehouse.table(check.table)
    arguments = dict(check.arguments)
    if "parent" in arguments:
        arguments["parent"] = warehouse.table(arguments["parent"])
    return getattr(checks, check.test)(rows, check.column, **arguments)


def _breaks(check: Check) -> Column:
    """Whether the row at hand breaks a check that looks at one row at a time."""
    column = F.col(check.column)
    if check.test == "not_null":
        return column.isNull()
    if check.test == "between":
        return checks.is_outside(column, **check.arguments)
    return checks.is_unexpected(column, **check.arguments)


def _cells(table: str, suite: Sequence[Check]) -> list[tuple[Column, Column]]:
    """What a row of ``table`` has to say, and where: (check, value, rows, parents), or NULL."""

    def cell(place: int, value: Column, rows: int, parents: int, where: Column) -> tuple[Column, Column]:
        parts = [F.lit(place).alias("place"), value.cast("string").alias("value"), F.lit(rows).alias("rows"), F.lit(parents).alias("parents")]
        return where, F.when(where, F.struct(*parts))

    cells = []
    for place, check in enumerate(suite):
        column = F.col(check.column)
        if check.table == table and check.test in BY_KEY:
            cells.append(cell(place, column, 1, 0, column.isNotNull()))
        elif check.table == table:
            value = column if check.test == "accepted_values" else F.lit(None)
            cells.append(cell(place, value, 1, 0, F.coalesce(_breaks(check), F.lit(False))))
        if check.arguments.get("parent") == table:
            key = F.col(check.arguments["parent_column"])
            cells.append(cell(place, key, 0, 1, key.isNotNull()))
    return cells


def _failures(place: Column, rows: Column, parents: Column, suite: Sequence[Check]) -> Column:
    """Failures among the rows with one value: a repeated or unexpected value counts once,
    orphan and other rows each."""
    of = {test: [i for i, check in enumerate(suite) if check.test == test] for test in ("unique", "accepted_values", "relationships")}
    return (
        F.when(place.isin(of["unique"]), F.when(rows > 1, 1).otherwise(0))
        .when(place.isin(of["accepted_values"]), F.lit(1))
        .when(place.isin(of["relationships"]), F.when(parents == 0, rows).otherwise(0))
        .otherwise(rows)
    )


def report(warehouse: Warehouse, suite: Iterable[Check] = tuple(SUITE), carried: Mapping[str, str] | None = None) -> DataFrame:
    """One line per check: table, column, test, failures, passed.

    Every table is read once, for all that its rows say of any check: breaches, keys that
    have to be unique, keys that refer and keys that are referred to. Counts by check
    and value then settle all checks together, in one shuffle that combines first.
    Checks that were seen to pass when a table was written (``warehouse.passed``) read
    nothing. ``carried``: models whose rows and columns another has, which is asked in
    their place.
    """
    suite = list(suite)
    spark = next(iter(warehouse.tables.values())).sparkSession
    listed = spark.createDataFrame(
        [(i, c.table, c.column, c.test) for i, c in enumerate(suite)], "place int, table_name string, column_name string, test string"
    )
    carried = dict(carried or {})
    asked = [
        replace(check, table=carried.get(check.table, check.table)) if check.name not in warehouse.passed else Check("", check.column, "")
        for check in suite
    ]
    parts = []
    for table in dict.fromkeys(t for c in asked for t in (c.table, c.arguments.get("parent")) if t):
        wheres, cells = zip(*_cells(table, asked), strict=True)
        said = F.filter(F.array(*cells), lambda c: c.isNotNull())
        # Most rows of most tables have nothing to say.
        speaking = warehouse.table(table).where(reduce(or_, wheres))
        parts.append(speaking.select(F.explode(said).alias("cell")).select("cell.*"))
    lines = ["table_name", "column_name", "test"]
    if not parts:
        return listed.select(*lines, F.lit(0).cast("long").alias("failures"), F.lit(True).alias("passed"))
    counted = reduce(DataFrame.unionAll, parts).groupBy("place", "value").agg(F.sum("rows").alias("rows"), F.sum("parents").alias("parents"))
    failures = _failures(F.col("place"), F.col("rows"), F.col("parents"), asked)
    found = counted.groupBy("place").agg(F.sum(failures).alias("failures"))
    failed = F.coalesce("failures", F.lit(0))
    # At most a row per check on either side.
    return listed.join(F.broadcast(found), "place", "left").select(*lines, failed.alias("failures"), (failed == 0).alias("passed"))


class Watch:
    """Counts breaches while tables are written, so that a check that finds none needs no
    look at the table. Wrapped around a model, it adds metrics to its plan. ``carried``: models
    whose rows and columns another has, which is asked in their place."""

    def __init__(self, suite: Iterable[Check] = tuple(SUITE), carried: Mapping[str, str] | None = None):
        self.suite = [check for check in suite if check.test not in BY_KEY]
        self.carried = dict(carried or {})
        self.observed: list[tuple[list[list[Check]], Observation]] = []

    def __call__(self, table: str, rows: DataFrame) -> DataFrame:
        mine = [check for check in self.suite if self.carried.get(check.table, check.table) == table]
        if not mine:
            return rows
        # One metric for equal checks of the table and of those it carries.
        alike: dict[str, list[Check]] = {}
        for check in mine:
            alike.setdefault(repr((check.column, check.test, check.arguments)), []).append(check)
        groups = list(alike.values())
        observation = Observation(f"{table}-{uuid.uuid4().hex}")
        self.observed.append((groups, observation))
        return rows.observe(observation, *[F.count_if(_breaks(group[0])).alias(f"check_{i}") for i, group in enumerate(groups)])

    def passed(self, patience: float = 10.0) -> set[str]:
        """Names of the checks that found nothing, once what was wrapped has been written.

        A plan may run some of its parts twice (sampling does), so that counts are
        too high; zero is zero. A part that the planner left out says nothing.
        """
        found = set()
        for groups, observation in self.observed:
            end = time.monotonic() + patience
            done = observation._jo.future()
            while not done.isCompleted() and time.monotonic() < end:
                time.sleep(0.05)
            if done.isCompleted():
                counts = observation.get
                found |= {check.name for i, group in enumerate(groups) if counts[f"check_{i}"] == 0 for check in group}
        self.observed.clear()
        return found

"""All models over one set of raw tables."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from scriptledger.operators.distinct_rules import NameLimit
from scriptledger.operators.lookup import LOOKUP_ROW_LIMIT, hinted, rows_up_to
from scriptledger.plans import intermediate, mart, staging

RAW = ["open_payments", "part_d_prescribers", "part_d_by_drug", "drug_company_seed"]
STAGING = ["stg_open_payments", "stg_part_d_prescribers", "stg_part_d_by_drug"]
INTERMEDIATE = [
    "int_drug_company_mapping",
    "int_physician_payments_agg",
    "int_physician_drug_prescribing",
]
# Written wave by wave: each wave uses the ones before it, and its own tables
# are independent of each other.
MART_WAVES = [
    ["fact_payments", "fact_prescriptions", "dim_drug"],
    ["dim_company", "dim_physician", "bridge_physician_company_payments"],
    ["fact_payment_prescribing"],
]
MART = [name for wave in MART_WAVES for name in wave]


class Warehouse:
    """Lazy frames for every layer.

    ``tables`` maps table names to frames. The raw tables have to be there
    unless every model asked for is; any model found in it (because it was
    written out) is used as it is, the others are composed on demand.

    ``passed`` names checks that these very tables are known to pass; ``watch`` is
    wrapped around each model that is composed. ``names``: staging applies its rules
    for companies, categories and specialties once per distinct name, if these are
    no more than that; it counts them when a staging model is first composed.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        lookup_row_limit: int = LOOKUP_ROW_LIMIT,
        passed: Collection[str] = (),
        watch: Callable[[str, DataFrame], DataFrame] | None = None,
        names: NameLimit | None = None,
    ):
        self.tables = dict(tables)
        self.lookup_row_limit = lookup_row_limit
        self.passed = frozenset(passed)
        self.names = names
        self.watch = watch or (lambda name, model: model)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            if name in RAW:
                raise KeyError(f"raw table {name} was not given")
            self.tables[name] = self.watch(name, getattr(self, f"_{name}")())
        return self.tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW or name in STAGING or name in INTERMEDIATE or name in MART:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def lookup_rows(self) -> int:
        """Size of the lookup, counted once and no further than the limit. It
        bounds every list of makers or classes of attributed prescriptions."""
        lookup = self.tables.get("drug_company_seed", self.tables.get("dim_drug"))
        if lookup is None:
            return self.lookup_row_limit + 1
        return rows_up_to(lookup, self.lookup_row_limit)

    def may_broadcast(self, rows_per_lookup_row: int = 1) -> bool:
        """Whether a frame with at most this many rows for each row of the
        lookup is surely small."""
        return self.lookup_rows * rows_per_lookup_row <= self.lookup_row_limit

    @property
    def lookup_is_small(self) -> bool:
        return self.may_broadcast()

    def small_lookup(self) -> DataFrame:
        return hinted(self.int_drug_company_mapping, self.lookup_is_small)

    def register_views(self) -> None:
        """Temporary views of the mart, for ``spark.sql``."""
        for name in MART:
            self.table(name).createOrReplaceTempView(name)

    # One method per model; ``table`` calls them.

    def _stg_open_payments(self) -> DataFrame:
        return staging.stg_open_payments(self.open_payments, self.names)

    def _stg_part_d_prescribers(self) -> DataFrame:
        return staging.stg_part_d_prescribers(self.part_d_prescribers, self.names)

    def _stg_part_d_by_drug(self) -> DataFrame:
        return staging.stg_part_d_by_drug(self.part_d_by_drug)

    def _int_drug_company_mapping(self) -> DataFrame:
        return intermediate.int_drug_company_mapping(self.drug_company_seed)

    def _payments(self) -> DataFrame:
        """Cleaned payments: the written fact, which has every staging column,
        saves cleaning them again."""
        if "fact_payments" in self.tables:
            return self.tables["fact_payments"]
        return self.stg_open_payments

    def _int_physician_payments_agg(self) -> DataFrame:
        return intermediate.int_physician_payments_agg(self._payments())

    def _int_physician_drug_prescribing(self) -> DataFrame:
        return intermediate.int_physician_drug_prescribing(self.fact_prescriptions)

    def _fact_payments(self) -> DataFrame:
        return mart.fact_payments(self.stg_open_payments)

    def _fact_prescriptions(self) -> DataFrame:
        return mart.fact_prescriptions(self.stg_part_d_by_drug, self.small_lookup())

    def _dim_physician(self) -> DataFrame:
        return mart.dim_physician(self.stg_part_d_prescribers, self._payments())

    def _dim_company(self) -> DataFrame:
        return mart.dim_company(self._payments(), self.int_drug_company_mapping)

    def _dim_drug(self) -> DataFrame:
        return mart.dim_drug(self.int_drug_company_mapping)

    def _bridge_physician_company_payments(self) -> DataFrame:
        return mart.bridge_physician_company_payments(self.int_physician_payments_agg)

    def _fact_payment_prescribing(self) -> DataFrame:
        # The same pairs and claims as the model with the names of the brands.
        totals = self.watch("int_physician_drug_prescribing", intermediate.prescribing_totals(self.fact_prescriptions))
        return mart.fact_payment_prescribing(self.bridge_physician_company_payments, totals, self.dim_physician)

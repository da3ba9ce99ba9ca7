"""Batch build: load the sources, write the mart, count what was written.

Tables are versions in a store (``sources.store``): a build appears whole or not at
all, and one that was cut off goes on where it stopped. Checks that look at a row at
a time are counted while the rows are written.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from scriptledger import schemas
from scriptledger.functions import columns, ratios, rules
from scriptledger.operators.distinct_rules import NameLimit
from scriptledger.operators.lookup import fits_broadcast, hinted
from scriptledger.plans import intermediate, mart, quality_suite, staging
from scriptledger.plans.warehouse import MART, MART_WAVES, RAW, Warehouse
from scriptledger.sources import csv_splits, files, load, sinks
from scriptledger.sources.store import Store, Written, code_fingerprint, files_fingerprint, fingerprint

SKIPPED = -1

LOAD_STEPS = ["open_payments", "part_d_prescribers", "part_d_by_drug"]

# Which models are written; the rest stay lazy and are inlined by the planner.
MATERIALIZED = tuple(MART)

# Directory layout that lets a class filter skip the other classes' files.
PARTITIONED = {"fact_prescriptions": ["therapeutic_class"]}

# Order of rows over files. Pages filter payments by company and prescriptions by class;
# the physician splits a hot one, and a look-up within it reads one range of files.
CLUSTERED = {
    **dict.fromkeys(
        ["fact_payments", "bridge_physician_company_payments", "fact_payment_prescribing"],
        ["company_name", "physician_npi"],
    ),
    "fact_prescriptions": ["therapeutic_class", "physician_npi"],
}
# Columns to look single values up by, wherever their rows stand.
FOUND_BY = {name: ["physician_npi"] for name in CLUSTERED}

# Tables with few rows per physician, which may be bucketed on it. The event
# tables are not: one physician's rows would all be one task's.
BUCKETED = {
    "dim_physician": "physician_npi",
    "bridge_physician_company_payments": "physician_npi",
    "fact_payment_prescribing": "physician_npi",
}


# What each table is made from, for builds that go on where another stopped.
MADE_FROM = {
    "fact_payments": ["open_payments"],
    "fact_prescriptions": ["part_d_by_drug", "drug_company_seed"],
    "dim_drug": ["drug_company_seed"],
    "dim_company": ["fact_payments", "drug_company_seed"],
    "dim_physician": ["part_d_prescribers", "fact_payments"],
    "bridge_physician_company_payments": ["fact_payments"],
    "fact_payment_prescribing": ["bridge_physician_company_payments", "fact_prescriptions", "dim_physician"],
}
# Models that are not written, by the table that is written from the very same rows.
CARRIES = {
    "fact_payments": ["stg_open_payments"],
    "fact_prescriptions": ["stg_part_d_by_drug"],
    "dim_drug": ["int_drug_company_mapping"],
    "dim_physician": ["stg_part_d_prescribers"],
    "bridge_physician_company_payments": ["int_physician_payments_agg"],
    "fact_payment_prescribing": ["int_physician_drug_prescribing"],
}
# Of these, models whose very columns the table has: their checks are counted on it.
CARRIED = {"stg_open_payments": "fact_payments", "int_physician_payments_agg": "bridge_physician_company_payments"}
LAYOUT_VERSION = 1
CODE = [columns, ratios, rules, load, files, csv_splits, staging, intermediate, mart, schemas]


@dataclass
class Built:
    """``counts``: rows of each step, -1 where skipped; ``written``: where the tables
    are; ``reused``: those that an earlier build had made from the same."""

    warehouse: Warehouse
    counts: dict[str, int] = field(default_factory=dict)
    written: dict[str, Written] = field(default_factory=dict)
    reused: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class SourceFiles:
    """Where the extracts and the curated lookup are. An extract may be several
    files; of a payments folder with several years, ``years`` says which to load.
    ``multi_line=False`` lets files without quoted line breaks be split."""

    open_payments_dir: str
    prescribers_csv: str | Sequence[str]
    by_drug_csv: str | Sequence[str]
    seed_csv: str
    years: Sequence[int] | None = None
    multi_line: bool = True


@dataclass(frozen=True)
class LoadFilters:
    """What the load keeps; ``None`` keeps all."""

    min_payment: float | None = rules.MIN_PAYMENT_USD
    prefixes: Sequence[str] | None = tuple(rules.LOAD_COMPANY_PREFIXES)
    min_claims: int | None = rules.MIN_TOTAL_CLAIMS
    fragments: Sequence[str] | None = tuple(rules.LOAD_SPECIALTY_FRAGMENTS)


def write_together(writes: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Run independent writes side by side, so that one table's last tasks do
    not leave the cluster idle. The first failure is raised."""
    with ThreadPoolExecutor(max_workers=max(len(writes), 1)) as pool:
        running = {name: pool.submit(write) for name, write in writes.items()}
        return {name: job.result() for name, job in running.items()}


def load_raw(
    spark: SparkSession,
    paths: SourceFiles,
    out: str,
    skip: Collection[str] = (),
    keep: LoadFilters = LoadFilters(),
    resume: bool = True,
    publish: bool = True,
) -> Built:
    """Filter the extracts into raw tables of the store at ``out``.

    A skipped step keeps the table of an earlier run, if there is one, and
    counts as -1. A step whose files, options and code are those of a table in the
    store is not run again, unless ``resume`` is False.
    """
    unknown = set(skip) - set(LOAD_STEPS)
    if unknown:
        raise ValueError(f"no such load step: {sorted(unknown)}")
    store = Store(spark, out)
    seed = files.read_drug_seed(spark, paths.seed_csv)
    seed_print = files_fingerprint(spark, [paths.seed_csv])
    small = hinted(seed, fits_broadcast(seed))
    as_list = lambda given: [given] if isinstance(given, str) else list(given)
    sources = {
        "open_payments": lambda: files.payment_files(spark, paths.open_payments_dir, paths.years),
        "part_d_prescribers": lambda: [f for p in as_list(paths.prescribers_csv) for f in files.list_files(spark, p)],
        "part_d_by_drug": lambda: [f for p in as_list(paths.by_drug_csv) for f in files.list_files(spark, p)],
    }
    options = {
        "open_payments": [keep.min_payment, keep.prefixes],
        "part_d_prescribers": [keep.min_claims, keep.fragments],
        "part_d_by_drug": [seed_print],
    }
    steps = {
        "open_payments": lambda: load.load_open_payments(
            files.read_open_payments(spark, paths.open_payments_dir, paths.years, paths.multi_line),
            keep.min_payment,
            keep.prefixes,
        ),
        "part_d_prescribers": lambda: load.load_part_d_prescribers(
            files.read_prescribers(spark, paths.prescribers_csv, paths.multi_line),
            keep.min_claims,
            keep.fragments,
        ),
        "part_d_by_drug": lambda: load.load_part_d_by_drug(
            files.read_by_drug(spark, paths.by_drug_csv, paths.multi_line), small
        ),
    }
    code = code_fingerprint(CODE)
    prints = {
        name: fingerprint(LAYOUT_VERSION, code, name, files_fingerprint(spark, sources[name]()), options[name], paths.multi_line)
        for name in LOAD_STEPS
        if name not in skip
    }
    built = _write_steps(store, "raw", prints, lambda name: steps[name](), resume)
    earlier = store.steps()
    for name in skip:
        built.counts[name] = SKIPPED
        if name in earlier:
            built.written[name] = earlier[name]
    if publish:
        store.publish(built.written)
    tables = {name: spark.read.parquet(store.at(w.path)) for name, w in built.written.items()}
    built.written["drug_company_seed"] = Written("drug_company_seed", paths.seed_csv, seed_print, SKIPPED)
    built.counts = {name: built.counts[name] for name in LOAD_STEPS}
    built.warehouse = Warehouse({"drug_company_seed": seed, **tables}, passed=_passed(built.written))
    return built


def _passed(written: Mapping[str, Written]) -> set[str]:
    return {check for w in written.values() for check in w.passed}


def _about(table: str, passed: Collection[str]) -> tuple[str, ...]:
    """Of names of checks, those that hold for a version of ``table``."""
    models = [table, *CARRIES.get(table, [])]
    return tuple(sorted(name for name in passed if name.split(".")[0] in models))


def _write_steps(
    store: Store,
    layer: str,
    prints: Mapping[str, str | None],
    frame: Callable[[str], DataFrame],
    resume: bool = True,
    write: Callable | None = None,
    watch: quality_suite.Watch | None = None,
) -> Built:
    """Write independent tables side by side, but for those that the store has.
    ``prints``: what each is made from, or None where that is not known. Each
    table is recorded as soon as it is whole."""
    watch = watch or quality_suite.Watch()
    write = write or (lambda name, rows, path: sinks.replace_parquet(rows, path, watch=lambda last: watch(name, last)))
    known = store.made_from({p for p in prints.values() if p}) if resume else {}
    built = Built(Warehouse({}))
    for name, print_ in prints.items():
        if print_ in known:
            built.written[name] = known[print_]
            built.reused.append(name)
    # composed here, one after another; only the writing is concurrent
    paths = {name: store.new_path(layer, name) for name in prints if name not in built.written}
    frames = {name: frame(name) for name in paths}
    done = {}
    try:
        write_together(
            {name: lambda name=name: done.setdefault(name, write(name, frames[name], store.at(paths[name])).count()) for name in frames}
        )
    finally:  # one that fails costs the others nothing
        passed = watch.passed() if done else set()
        fresh = [Written(name, paths[name], prints[name], rows, _about(name, passed)) for name, rows in done.items()]
        store.record(w for w in fresh if w.fingerprint)
    built.written |= {w.table: w for w in fresh}
    built.counts = {name: built.written[name].rows for name in prints}
    return built


def build_mart(
    raw: Warehouse,
    out: str,
    materialized: Collection[str] = MATERIALIZED,
    bucket_schema: str | None = None,
    buckets: int = 0,
    made_from: Mapping[str, Written] | None = None,
    resume: bool = True,
    publish: bool = True,
) -> Built:
    """Write the chosen models into the store at ``out``, each from what was written
    before it, and publish them together.

    With ``bucket_schema`` and ``buckets``, the physician-keyed tables become
    bucketed catalog tables instead, which join without a shuffle.

    ``made_from``: the versions that ``raw`` reads. Where they are known, a model made
    from the same by the same code is not written again, unless ``resume`` is False.
    """
    spark = next(iter(raw.tables.values())).sparkSession
    store = Store(spark, out)
    tables = {name: raw.table(name) for name in RAW if name in raw.tables}
    versions = dict(made_from or {})
    built = Built(raw)
    code = code_fingerprint(CODE)

    def print_of(name: str) -> str | None:
        inputs = [versions.get(n) for n in MADE_FROM[name]]
        if bucket_schema or any(v is None or v.fingerprint is None for v in inputs):
            return None
        layout = [PARTITIONED.get(name), CLUSTERED.get(name), FOUND_BY.get(name)]
        return fingerprint(LAYOUT_VERSION, code, name, layout, [v.fingerprint for v in inputs])

    for wave in MART_WAVES:
        watch = quality_suite.Watch(carried=CARRIED)

        def write(name: str, model: DataFrame, path: str, watch=watch) -> DataFrame:
            if bucket_schema and name in BUCKETED:
                return sinks.replace_bucketed(watch(name, model), f"{bucket_schema}.{name}", BUCKETED[name], buckets, path)
            layout = [options.get(name, ()) for options in (PARTITIONED, CLUSTERED, FOUND_BY)]
            return sinks.replace_parquet(model, path, *layout, watch=lambda rows: watch(name, rows))

        # Tables are watched as they are written, models within them as they are composed.
        models = Warehouse(
            tables, raw.lookup_row_limit, watch=lambda name, model, watch=watch: model if name in MART else watch(name, model), names=raw.names
        )
        prints = {name: print_of(name) for name in wave if name in materialized}
        done = _write_steps(store, "mart", prints, models.table, resume, write, watch)
        for name, version in done.written.items():
            if bucket_schema and name in BUCKETED:  # the catalog knows the buckets
                tables[name] = spark.table(f"{bucket_schema}.{name}")
            else:
                tables[name] = sinks.read_parquet(spark, store.at(version.path), DECLARED.get(name))
        versions |= done.written
        built.written |= done.written
        built.reused += done.reused
        built.counts |= done.counts
    if publish:
        store.publish(built.written)
    built.warehouse = Warehouse(tables, raw.lookup_row_limit, raw.passed | _passed(built.written))
    return built


# A table in class directories has the type of the class declared.
DECLARED = {"fact_prescriptions": schemas.FACT_PRESCRIPTIONS}


def _published(spark: SparkSession, out: str, names: Collection[str]) -> tuple[dict[str, DataFrame], set[str]]:
    store = Store(spark, out)
    found = store.published()
    absent = [name for name in names if name not in found]
    if absent:
        raise FileNotFoundError(f"no build at {out} has {absent}")
    chosen = {name: found[name] for name in names}
    return {name: sinks.read_parquet(spark, store.at(w.path), DECLARED.get(name)) for name, w in chosen.items()}, _passed(chosen)


def open_mart(spark: SparkSession, out: str, names: Collection[str] = MATERIALIZED) -> Warehouse:
    """A warehouse over the tables of the last build that was published at ``out``."""
    tables, passed = _published(spark, out, names)
    return Warehouse(tables, passed=passed)


def open_warehouse(spark: SparkSession, out: str, seed_csv: str | None = None) -> Warehouse:
    """Raw tables and mart of an earlier ``build``, for checks in a new session.
    ``seed_csv``: the curated lookup, which the build reads but does not copy."""
    tables, passed = _published(spark, out, [*LOAD_STEPS, *MATERIALIZED])
    if seed_csv is not None:
        tables["drug_company_seed"] = files.read_drug_seed(spark, seed_csv)
    return Warehouse(tables, passed=passed)


def build(
    spark: SparkSession,
    paths: SourceFiles,
    out: str,
    skip: Collection[str] = (),
    keep: LoadFilters = LoadFilters(),
    resume: bool = True,
    names: NameLimit | None = None,
) -> Built:
    """Extracts to mart in one call, with the counts of every step.

    Readers keep the tables of the build before until all are written. After a failure,
    the same call goes on with the steps that are missing. ``names``: see ``Warehouse``.
    """
    loaded = load_raw(spark, paths, out, skip, keep, resume, publish=False)
    loaded.warehouse.names = names
    models = build_mart(loaded.warehouse, out, made_from=loaded.written, resume=resume, publish=False)
    written = {name: w for name, w in loaded.written.items() if name in LOAD_STEPS} | models.written
    Store(spark, out).publish(written)
    return Built(models.warehouse, {**loaded.counts, **models.counts}, written, loaded.reused + models.reused)

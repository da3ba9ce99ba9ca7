"""Extract files to mart."""

import csv
from datetime import date
from decimal import Decimal

import pytest

from frames import rows

from scriptledger import schemas
from scriptledger.plans import pipeline, quality_suite
from scriptledger.plans.warehouse import MART
from scriptledger.sources import files


def write_csv(path, header, lines, raw_tail=""):
    with open(path, "w", encoding="latin-1", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(header)
        writer.writerows(lines)
        out.write(raw_tail)


PAYMENT_HEADER = ["Record_ID", *schemas.OPEN_PAYMENTS_HEADER, "Program_Year"]


@pytest.fixture
def paths(tmp_path):
    extracts = tmp_path / "extracts"
    extracts.mkdir()
    write_csv(
        extracts / "OP_DTL_GNRL_PGYR2022_x.csv",
        PAYMENT_HEADER,
        [
            [1, "0012345678", "Pfizer Inc, Ltd", "50.00", "01/31/2022", "Consulting Fee", "NY", 2022],
            [2, "12345678", "Janssen \"Bio\"", "60.5", "2022-02-28", "Gift", "NY", 2022],
            [3, "12345678", "Pfizer", "49.996", "01/31/2022", "Gift", "NY", 2022],
            [4, "12345678", "Pfizer", "not a number", "01/31/2022", "Gift", "NY", 2022],
            [5, "", "Pfizer", "500", "01/31/2022", "Gift", "NY", 2022],
            [6, "12345678", " Pfizer", "500", "01/31/2022", "Gift", "NY", 2022],
            [7, "12345678", "Sanofi", "500", "01/31/2022", "Gift", "NY", 2022],
            [8, "12345678", "Merck", "1e3", "bad date", "Café, Gift", "NY", 2022],
            [9, "12345678", "BRISTOL LABS", "70", "01/31/2022", "Gift", "", 2022],
            # one field too many: the line is kept without it
            [10, "12345678", "Merck", "90", "01/31/2022", "Gift", "NY", 2022, "extra"],
        ],
        # too few fields: padded
        raw_tail="11,12345678,Merck,91,01/31/2022,Gift\n",
    )
    (extracts / "notes.csv").write_text("nothing\n")
    write_csv(
        tmp_path / "prescribers.csv",
        [*schemas.PRESCRIBERS_HEADER],
        [
            ["12345678", "A", "B", "Family Practice", "NY", "155.0", "10.50", "12.0"],
            ["2", "A", "B", "Podiatry", "NY", "155", "10.50", "12"],
            ["3", "A", "B", "Urology", "NY", "9", "10.50", "12"],
            ["4", "A", "B", "Urology", "NY", "10", "", ""],
            ["5", "A", "B", "Urology", "NY", "*", "1", "1"],
        ],
    )
    write_csv(
        tmp_path / "by_drug.csv",
        [*schemas.BY_DRUG_HEADER],
        [
            ["12345678", "ALPHA\t", "gen", "12.0", "100.10"],
            ["12345678", "Alpha", "gen", "3", "7"],
            ["12345678", "Other", "gen", "3", "7"],
            ["4", "Alpha", "gen", "", "7"],
        ],
    )
    write_csv(
        tmp_path / "seed.csv",
        schemas.DRUG_SEED.names,
        [["Alpha", "gen", "PFIZER", "Oncology"]],
    )
    return pipeline.SourceFiles(
        str(extracts),
        str(tmp_path / "prescribers.csv"),
        str(tmp_path / "by_drug.csv"),
        str(tmp_path / "seed.csv"),
    )


def test_load_filters_and_coercion(spark, paths, tmp_path):
    loaded = pipeline.load_raw(spark, paths, str(tmp_path / "out"))
    assert loaded.counts == {"open_payments": 6, "part_d_prescribers": 2, "part_d_by_drug": 2}
    day = date(2022, 1, 31)
    assert rows(loaded.warehouse.open_payments) == [
        ("0012345678", "Pfizer Inc, Ltd", Decimal("50.00"), day, "Consulting Fee", "NY"),
        ("12345678", "BRISTOL LABS", Decimal("70.00"), day, "Gift", None),
        ("12345678", 'Janssen "Bio"', Decimal("60.50"), date(2022, 2, 28), "Gift", "NY"),
        ("12345678", "Merck", Decimal("1000.00"), None, "Café, Gift", "NY"),
        ("12345678", "Merck", Decimal("90.00"), day, "Gift", "NY"),
        ("12345678", "Merck", Decimal("91.00"), day, "Gift", None),
    ]
    assert rows(loaded.warehouse.part_d_prescribers, "physician_npi", "total_claim_count") == [
        ("12345678", 155),
        ("4", 10),
    ]
    assert loaded.warehouse.open_payments.schema == schemas.OPEN_PAYMENTS
    assert loaded.warehouse.part_d_prescribers.schema == schemas.PART_D_PRESCRIBERS
    assert loaded.warehouse.part_d_by_drug.schema == schemas.PART_D_BY_DRUG


def test_skipped_steps(spark, paths, tmp_path):
    out = str(tmp_path / "out")
    pipeline.load_raw(spark, paths, out)
    again = pipeline.load_raw(spark, paths, out, skip=["open_payments"])
    assert again.counts["open_payments"] == -1
    assert again.warehouse.open_payments.count() == 6
    with pytest.raises(ValueError):
        pipeline.load_raw(spark, paths, out, skip=["nothing"])
    fresh = pipeline.load_raw(spark, paths, str(tmp_path / "fresh"), skip=["open_payments"])
    with pytest.raises(KeyError):
        fresh.warehouse.table("open_payments")


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_open_payments(spark, str(tmp_path / "absent"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_open_payments(spark, str(tmp_path / "empty"))
    write_csv(tmp_path / "p.csv", ["Prscrbr_NPI"], [["1"]])
    with pytest.raises(ValueError, match="Tot_Clms"):
        files.read_by_drug(spark, str(tmp_path / "p.csv"))


def test_build_is_repeatable_and_reads_back(spark, paths, tmp_path):
    out = str(tmp_path / "out")
    first = pipeline.build(spark, paths, out)
    second = pipeline.build(spark, paths, out)
    assert first.counts == second.counts
    assert set(MART) < set(first.counts)
    opened = pipeline.open_mart(spark, out)
    for name in MART:
        assert rows(opened.table(name)) == rows(second.warehouse.table(name))
    report = quality_suite.report(second.warehouse)
    failed = rows(report.where("not passed"), "table_name", "column_name", "failures")
    # this tiny seed has every class; only that the suite runs on it matters
    assert failed == []
    later = pipeline.open_warehouse(spark, out, paths.seed_csv)
    assert rows(quality_suite.report(later)) == rows(report)


def test_load_options(spark, paths, tmp_path):
    every = pipeline.LoadFilters(None, None, None, None)
    loaded = pipeline.load_raw(spark, paths, str(tmp_path / "all"), keep=every)
    # all but the rows without a physician, a company or a number
    assert loaded.counts == {"open_payments": 9, "part_d_prescribers": 4, "part_d_by_drug": 2}
    nothing = pipeline.LoadFilters(prefixes=[], fragments=[])
    none = pipeline.load_raw(spark, paths, str(tmp_path / "none"), keep=nothing)
    assert none.counts["open_payments"] == none.counts["part_d_prescribers"] == 0


def test_lazy_and_written_models_agree(spark, small, tmp_path):
    written = pipeline.build_mart(small, str(tmp_path)).warehouse
    for name in MART:
        lazy = small.table(name)
        assert rows(written.table(name), *lazy.columns) == rows(lazy)


def test_views_take_sql_with_parameters(spark, small):
    small.register_views()
    found = spark.sql(
        "SELECT count(*) AS n FROM fact_payments WHERE company_name = :company",
        args={"company": "PFIZER"},
    )
    expected = small.fact_payments.where("company_name = 'PFIZER'").count()
    assert found.first().n == expected > 0
    positional = spark.sql("SELECT count(*) AS n FROM dim_physician WHERE state = ?", args=["AS"])
    assert positional.first().n > 0


def test_some_models_may_stay_lazy(spark, small, tmp_path):
    built = pipeline.build_mart(small, str(tmp_path), materialized=["dim_physician"])
    assert set(built.counts) == {"dim_physician"}
    assert built.counts["dim_physician"] == small.dim_physician.count()
    lazy = built.warehouse.fact_payment_prescribing
    assert lazy.count() == small.fact_payment_prescribing.count()

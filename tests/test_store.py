"""Builds that appear whole, go on where they stopped, and check while they write."""

import pytest

from frames import rows
from test_pipeline import paths  # noqa: F401  fixture

from scriptledger.plans import pipeline, quality_suite
from scriptledger.plans.warehouse import MART
from scriptledger.sources import sinks
from scriptledger.sources.store import Store, Written, fingerprint


def failing(monkeypatch, table):
    """Writes of ``table`` break off."""
    before = sinks.replace_parquet

    def write(frame, path, *more, **options):
        if f"/{table}/" in path:
            raise OSError(f"no more room for {table}")
        return before(frame, path, *more, **options)

    monkeypatch.setattr(sinks, "replace_parquet", write)
    return before


def test_versions_are_published_together(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.published() == store.steps() == {} and store.remove_unpublished() == []
    first = {name: Written(name, store.new_path("mart", name), fingerprint(name), 1) for name in "ab"}
    for w in first.values():
        spark.range(1).write.parquet(store.at(w.path))
    store.record(first.values())
    assert store.published() == {} and store.steps() == first
    store.publish(first)
    second = Written("a", store.new_path("mart", "a"), None, 2, ("a.id.not_null",))
    spark.range(2).write.parquet(store.at(second.path))
    store.record([second])
    again = Store(spark, str(tmp_path))
    assert again.published() == first and again.steps()["a"] == second
    again.publish({"a": second})
    assert again.published() == {"a": second, "b": first["b"]} and again.published(1) == first and again.published(2) == {}
    assert again.made_from({fingerprint("a"), "other"}) == {fingerprint("a"): first["a"]}
    assert again.remove_unpublished(keep=2) == [] and again.remove_unpublished() == [first["a"].path]
    assert not (tmp_path / first["a"].path).exists() and (tmp_path / second.path).exists()


def test_a_build_that_fails_leaves_the_one_before_and_is_taken_up_again(spark, paths, tmp_path, monkeypatch):  # noqa: F811
    out = str(tmp_path / "out")
    pipeline.build(spark, paths, out)
    before = {name: rows(pipeline.open_mart(spark, out).table(name)) for name in MART}
    more = pipeline.LoadFilters(None, None, None, None)
    with monkeypatch.context() as broken:
        failing(broken, "fact_payment_prescribing")
        with pytest.raises(OSError, match="no more room"):
            pipeline.build(spark, paths, out, keep=more)
    # Readers see the first build, whole.
    assert {name: rows(pipeline.open_mart(spark, out).table(name)) for name in MART} == before
    written = []
    replace = sinks.replace_parquet
    monkeypatch.setattr(sinks, "replace_parquet", lambda frame, path, *more, **options: written.append(path.split("/")[-2]) or replace(frame, path, *more, **options))
    after = pipeline.build(spark, paths, out, keep=more)
    assert written == ["fact_payment_prescribing"]
    assert set(after.reused) == {*pipeline.LOAD_STEPS, *MART} - {"fact_payment_prescribing"}
    fresh = pipeline.build(spark, paths, str(tmp_path / "fresh"), keep=more)
    for name in MART:
        assert rows(pipeline.open_mart(spark, out).table(name)) == rows(fresh.warehouse.table(name))
    assert after.counts == fresh.counts


def test_only_what_changed_is_written_again(spark, paths, tmp_path):  # noqa: F811
    out = str(tmp_path / "out")
    pipeline.build(spark, paths, out)
    assert set(pipeline.build(spark, paths, out).reused) == {*pipeline.LOAD_STEPS, *MART}
    with open(paths.prescribers_csv, "a", encoding="latin-1", newline="") as file:
        file.write("77,A,B,Urology,CA,900,1,1\r\n")
    again = pipeline.build(spark, paths, out)
    assert set(MART) - set(again.reused) == {"dim_physician", "fact_payment_prescribing"}
    assert pipeline.open_mart(spark, out).dim_physician.where("physician_npi = '0000000077'").count() == 1
    assert pipeline.build(spark, paths, out, resume=False).reused == []


def test_one_failing_table_costs_the_others_of_its_wave_nothing(spark, paths, tmp_path, monkeypatch):  # noqa: F811
    out = str(tmp_path / "out")
    with monkeypatch.context() as broken:
        failing(broken, "dim_company")
        with pytest.raises(OSError):
            pipeline.build(spark, paths, out)
    assert {"dim_physician", "bridge_physician_company_payments"} <= set(Store(spark, out).steps())
    with pytest.raises(FileNotFoundError):
        pipeline.open_mart(spark, out)
    assert "dim_physician" in pipeline.build(spark, paths, out).reused


ROW_CHECKS = [c for c in quality_suite.SUITE if c.test not in quality_suite.BY_KEY]


def test_checks_while_writing(spark, paths, tmp_path):  # noqa: F811
    out = str(tmp_path / "out")
    built = pipeline.build(spark, paths, out)
    # The curated lookup is an input and not written; all else passed on the way.
    unseen = {c.name for c in ROW_CHECKS if c.table != "drug_company_seed"} - built.warehouse.passed
    full = rows(quality_suite.report(pipeline.Warehouse(built.warehouse.tables)))
    failed = {f"{t}.{c}.{k}" for t, c, k, n, ok in full if not ok}
    assert unseen == failed - {c.name for c in quality_suite.SUITE if c.test in quality_suite.BY_KEY}
    assert rows(quality_suite.report(built.warehouse)) == full
    opened = pipeline.open_warehouse(spark, out, paths.seed_csv)
    assert opened.passed == built.warehouse.passed and rows(quality_suite.report(opened)) == full


def test_a_breach_is_not_taken_for_a_pass(spark, small, tmp_path):
    """Written rows that break their checks are counted by the report as without metrics."""
    tables = dict(small.tables)
    raw = pipeline.Warehouse({name: tables[name] for name in ("open_payments", "part_d_prescribers", "part_d_by_drug", "drug_company_seed")})
    nameless = raw.part_d_by_drug.limit(50).selectExpr("'5' AS physician_npi", "drug_brand_name", "drug_generic_name", "CAST(NULL AS INT) AS total_claim_count", "total_drug_cost_usd")
    broken = pipeline.Warehouse({**raw.tables, "part_d_by_drug": raw.part_d_by_drug.unionByName(nameless)})
    built = pipeline.build_mart(broken, str(tmp_path))
    assert "fact_prescriptions.physician_npi.not_null" in built.warehouse.passed
    assert "int_physician_drug_prescribing.company_claim_count.not_null" not in built.warehouse.passed
    full = rows(quality_suite.report(pipeline.Warehouse(built.warehouse.tables)))
    assert rows(quality_suite.report(built.warehouse)) == full
    assert ("int_physician_drug_prescribing", "company_claim_count", "not_null") in {x[:3] for x in full if not x[4]}


def test_the_report_reads_each_table_once(spark, small, tmp_path):
    built = pipeline.build_mart(small, str(tmp_path)).warehouse
    tables = {name: built.table(name) for name in [*MART, "open_payments", "part_d_prescribers", "part_d_by_drug", "drug_company_seed"]}
    raw = ("open_payments", "part_d_prescribers", "part_d_by_drug")
    for name in raw:
        tables[name].write.parquet(str(tmp_path / "raw" / name))
        tables[name] = spark.read.parquet(str(tmp_path / "raw" / name))
    for passed, most in (((), 8), (built.passed | {c.name for c in ROW_CHECKS if c.table in raw}, 4)):
        report = quality_suite.report(pipeline.Warehouse(tables, passed=passed))
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most
        read = [line for line in plan.splitlines() if "FileScan" in line and "payment_id" in line]
        assert len(read) <= 2
    # What was seen to pass leaves keys only.
    assert "payment_category" not in plan and "total_payment_usd" not in plan

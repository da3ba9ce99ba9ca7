"""Headline queries, end to end, on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` cores.

``python bench.py [folder]``: what is written goes to the folder, or to a
temporary one. First the extracts are written as CSV, untimed, and loaded with
the default filters (``load_csv``). Then the mart is built from the raw tables,
as a batch run would; each query reads what was written. Results are evaluated
whole into a null sink. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from scriptledger import registry, schemas
from scriptledger.plans import analyses, pipeline, quality_suite, views
from scriptledger.plans.warehouse import RAW, Warehouse
from scriptledger.session import build_session
from scriptledger.sources import driver_tables, files, load, sinks

COMPANY, CLASS = registry.COMPANY, registry.CLASS

HEADLINE = {
    "kol_identification": analyses.kol_identification,
    "payment_prescribing_correlation": analyses.payment_prescribing_correlation,
    "company_spend_efficiency": analyses.company_spend_efficiency,
    "geographic_market_analysis": analyses.geographic_market_analysis,
    "physician_loyalty_scoring": analyses.physician_loyalty_scoring,
    "dashboard_kpis": views.dashboard_kpis,
    "spend_by_company": views.spend_by_company,
    "spend_by_category": views.spend_by_category,
    "spend_by_specialty": views.spend_by_specialty,
    "paid_vs_unpaid_claims": views.paid_vs_unpaid_claims,
    "kol_finder": lambda w: views.kol_finder(w, CLASS),
    "kol_finder_unpaid": lambda w: views.kol_finder(w, CLASS, paid=False),
    "company_kpis": lambda w: views.company_kpis(w, COMPANY),
    "company_specialty_mix": lambda w: views.company_specialty_mix(w, COMPANY),
    "company_geography": lambda w: views.company_geography(w, COMPANY),
    "company_top_physicians": lambda w: views.company_top_physicians(w, COMPANY),
    "payment_group_summary": lambda w: views.payment_group_summary(w, COMPANY),
    "payment_rx_pearson": lambda w: views.payment_rx_pearson(w, COMPANY),
    "market_map": views.market_map,
    "dq_report": quality_suite.report,
}


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp(prefix="bench-")
    seconds: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def load_tables():
        lazy = registry.warehouse_over(spark, directory)
        writes = {
            name: lambda name=name: sinks.replace_parquet(lazy.table(name), f"{out}/raw/{name}")
            for name in RAW
        }
        return Warehouse(pipeline.write_together(writes))

    extracts = {
        "open_payments": schemas.OPEN_PAYMENTS_HEADER,
        "part_d_prescribers": schemas.PRESCRIBERS_HEADER,
        "part_d_by_drug": schemas.BY_DRUG_HEADER,
    }
    lazy = registry.warehouse_over(spark, directory)
    for name, header in extracts.items():
        text = driver_tables.as_text(lazy.table(name))
        rows = text.select([F.col(column).alias(title) for title, column in header.items()])
        rows.write.mode("overwrite").csv(f"{out}/csv/{name}", header=True, escape='"', encoding="ISO-8859-1")

    def load_csv():
        scans = {
            name: files.read_text_columns(spark, f"{out}/csv/{name}", header, multi_line=False)
            for name, header in extracts.items()
        }
        for frame in (
            load.load_open_payments(scans["open_payments"]),
            load.load_part_d_prescribers(scans["part_d_prescribers"]),
            load.load_part_d_by_drug(scans["part_d_by_drug"], lazy.drug_company_seed),
        ):
            frame.write.format("noop").mode("overwrite").save()

    timed("load_csv", load_csv)
    raw = timed("load_raw", load_tables)
    mart = timed("build_mart", lambda: pipeline.build_mart(raw, out)).warehouse
    for name, query in HEADLINE.items():
        timed(
            name, lambda: query(mart).write.format("noop").mode("overwrite").save()
        )
    print(
        json.dumps(
            {
                "metric": "build_and_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

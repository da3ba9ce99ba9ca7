"""The analyses on small made-up marts, against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import rows

from scriptledger.functions import rules
from scriptledger.functions.ratios import pearson_of
from scriptledger.plans import analyses, views
from scriptledger.plans.warehouse import Warehouse

RX = (
    "physician_npi string, drug_brand_name string, company_name string,"
    " therapeutic_class string, total_claim_count int, total_drug_cost_usd decimal(14,2)"
)
WHO = (
    "physician_npi string, physician_display_id string, specialty string, state string,"
    " received_pharma_payments boolean"
)
PAIRS = (
    "physician_npi string, company_name string, total_payment_usd decimal(24,2),"
    " payment_count bigint, company_claim_count bigint, company_drug_cost_usd decimal(24,2),"
    " specialty string, state string"
)


def rx(spark, *triples):
    return spark.createDataFrame(
        [(npi, "b", company, cls, claims, Decimal(2)) for npi, company, cls, claims in triples], RX
    )


def who(spark, npis, specialty="Urology", state="NY", paid=False):
    return spark.createDataFrame([(n, "#" + n, specialty, state, paid) for n in npis], WHO)


def pairs(spark, *quads):
    """(npi, company, payment, claims, specialty)"""
    return spark.createDataFrame(
        [(n, c, Decimal(str(p)), 1, k, Decimal(k), s, "NY") for n, c, p, k, s in quads], PAIRS
    )


def brute_force_kols(claims_of, top):
    """claims_of: {(class, npi): claims or None}"""
    out = []
    by_class = defaultdict(list)
    for (cls, npi), claims in claims_of.items():
        by_class[cls].append((npi, claims))
    for cls, members in by_class.items():
        order = sorted(members, key=lambda m: (m[1] is None, -(m[1] or 0), m[0]))
        total = sum(c or 0 for _, c in members)
        running = 0
        for rank, (npi, claims) in enumerate(order[:top], 1):
            running += claims or 0
            known = [c for _, c in members if c is not None]
            below = len(known) if claims is None else sum(c < claims for c in known)
            pr = below / (len(members) - 1) if len(members) > 1 else 0.0
            tier = "A" if pr >= 0.99 else "B" if pr >= 0.95 else "C" if pr >= 0.9 else "D"
            share = round(100 * running / total + 1e-9, 2) if total else None
            out.append((cls, tier, rank, npi, claims, share))
    return sorted(out, key=repr)


@pytest.mark.parametrize("values, top", [(30, 100), (3, 20), (400, 7)])
def test_kols_against_brute_force(spark, values, top):
    random.seed(values)
    claims_of, lines = {}, []
    for i in range(300):
        npi = f"{i:04d}"
        # one class holds most rows
        for cls in ("Oncology", "Oncology", "Neurology")[: random.randint(1, 3)]:
            claims = None if random.random() < 0.05 else random.randint(1, values)
            lines.append((npi, "PFIZER", cls, claims))
            old = claims_of.get((cls, npi))
            claims_of[cls, npi] = claims if old is None else old + (claims or 0)
    lines.append(("0001", "PFIZER", "Lonely", 4))
    claims_of["Lonely", "0001"] = 4
    lines.append(("unlisted", "PFIZER", "Oncology", 10_000))
    w = Warehouse(
        {
            "fact_prescriptions": rx(spark, *lines),
            "dim_physician": who(spark, [f"{i:04d}" for i in range(300)]),
        }
    )
    got = [
        (r.therapeutic_class, r.kol_tier[0], r.rank_in_class, r.physician_npi, r.class_claim_count, r.cumulative_share_pct)
        for r in analyses.kol_identification(w, top=top).collect()
    ]
    assert sorted(got, key=repr) == brute_force_kols(claims_of, top)


def test_kols_of_a_class_without_any_volume(spark):
    lines = [("1", "PFIZER", "Oncology", None), ("2", "PFIZER", "Oncology", None)]
    w = Warehouse({"fact_prescriptions": rx(spark, *lines), "dim_physician": who(spark, ["1", "2"])})
    got = rows(
        analyses.kol_identification(w), "rank_in_class", "physician_npi", "kol_tier", "cumulative_share_pct"
    )
    assert [(rank, npi, tier[0], share) for rank, npi, tier, share in got] == [
        (1, "1", "D", None),
        (2, "2", "D", None),
    ]


def test_correlation_against_numpy(spark):
    random.seed(3)
    quads = []
    for i in range(260):
        company = "PFIZER" if i % 3 else "MERCK"  # a hot company
        payment = random.choice([0, round(random.uniform(1, 5000), 2)])
        quads.append((f"{i}", company, payment, random.randint(0, 30), "Urology"))
    quads += [("u", "PFIZER", 9, 9, "Unknown"), ("n", "PFIZER", 9, 9, None)]
    w = Warehouse({"fact_payment_prescribing": pairs(spark, *quads)})
    got = {r.company_name: r for r in analyses.payment_prescribing_correlation(w, min_n=5).collect()}
    for company in ("PFIZER", "MERCK"):
        kept = [q for q in quads if q[1] == company and q[3] > 0 and q[4] == "Urology"]
        paid = [(p, k) for _, _, p, k, _ in kept if p > 0]
        free = [k for _, _, p, k, _ in kept if p == 0]
        row = got[company]
        assert (row.n_paid, row.n_unpaid) == (len(paid), len(free))
        assert row.avg_claims_paid == pytest.approx(np.mean([k for _, k in paid]), abs=0.0501)
        assert row.median_claims_paid == np.median([k for _, k in paid])
        assert row.median_claims_unpaid == np.median(free)
        assert row.lift_ratio == pytest.approx(
            np.mean([k for _, k in paid]) / np.mean(free), abs=0.00501
        )
        r = np.corrcoef(np.array(paid, dtype=float).T)[0, 1]
        assert row.pearson_correlation == pytest.approx(r, abs=0.000501)


def test_correlation_needs_thirty_on_both_sides(spark):
    def group(specialty, n_paid, n_unpaid):
        return [(f"{specialty}p{i}", "PFIZER", i + 1, 3 + i, specialty) for i in range(n_paid)] + [
            (f"{specialty}u{i}", "PFIZER", 0, 3, specialty) for i in range(n_unpaid)
        ]

    w = Warehouse(
        {
            "fact_payment_prescribing": pairs(
                spark, *group("a", 30, 30), *group("b", 29, 30), *group("c", 30, 29)
            )
        }
    )
    assert rows(analyses.payment_prescribing_correlation(w), "specialty") == [("a",)]


def test_constant_payments_have_no_correlation(spark):
    same = [(f"p{i}", "PFIZER", 123456.78, 3 + i, "a") for i in range(40)]
    free = [(f"u{i}", "PFIZER", 0, 3, "a") for i in range(40)]
    w = Warehouse({"fact_payment_prescribing": pairs(spark, *same, *free)})
    row = analyses.payment_prescribing_correlation(w).first()
    assert row.n_paid == 40
    assert row.pearson_correlation is None
    point = views.payment_rx_pearson(w, "PFIZER").first()
    assert (point.n_points, point.pearson) == (40, None)


def test_pearson_needs_ten_points(spark):
    line = [(f"{i}", "PFIZER", 10 * (i + 1), i + 1, "a") for i in range(10)]
    nine = Warehouse({"fact_payment_prescribing": pairs(spark, *line[:9])})
    ten = Warehouse({"fact_payment_prescribing": pairs(spark, *line)})
    assert views.payment_rx_pearson(nine, "PFIZER").first().pearson is None
    assert views.payment_rx_pearson(ten, "PFIZER").first().pearson == 1.0


def test_lift_needs_both_groups(spark):
    paid = [("1", "PFIZER", 5, 30, "a"), ("2", "PFIZER", 5, 31, "a")]
    alone = Warehouse({"fact_payment_prescribing": pairs(spark, *paid)})
    assert tuple(views.lift_ratio(alone, "PFIZER").first()) == (30.5, None, None)
    both = Warehouse({"fact_payment_prescribing": pairs(spark, *paid, ("3", "PFIZER", 0, 20, "a"))})
    assert tuple(views.lift_ratio(both, "PFIZER").first()) == (30.5, 20.0, 1.53)


def test_efficiency_shares(spark):
    w = Warehouse(
        {
            "fact_payment_prescribing": pairs(
                spark,
                ("1", "A", 100, 30, "s"),
                ("2", "A", 0, 10, "s"),
                ("1", "ONLY PAID", 50, 5, "s"),
                ("1", "NEVER PAYS", 0, 5, "s"),
            )
        }
    )
    got = {r.company_name: r for r in analyses.company_spend_efficiency(w).collect()}
    assert set(got) == {"A", "ONLY PAID"}
    assert got["A"].paid_share_of_total_rx_pct == 75.0
    assert got["A"].claims_per_1k_spend == 300.0
    assert got["ONLY PAID"].claims_from_unpaid is None
    assert got["ONLY PAID"].paid_share_of_total_rx_pct is None


def test_loyalty(spark):
    w = Warehouse(
        {
            "fact_prescriptions": rx(
                spark,
                ("1", "A", "c", 10),
                ("1", "B", "c", 10),
                ("1", "Z", "c", None),
                ("2", "A", "c", 19),
                ("3", "A", "c", 20),
                ("4", "A", "c", 1),
                ("4", "B", "c", 1),
                ("4", "C", "c", 4),
                ("4", "C", "c", 14),
                ("4", "B", "d", 400),
            ),
            "dim_physician": who(spark, ["1", "3"]),
        }
    )
    got = rows(
        analyses.physician_loyalty_scoring(w),
        "physician_npi",
        "therapeutic_class",
        "total_claims",
        "distinct_companies",
        "hhi_score",
        "dominant_company",
        "dominant_share_pct",
        "specialty",
    )
    assert got == [
        # a tie goes to the first name; NULL claims never dominate
        ("1", "c", 20, 3, 5000.0, "A", 50.0, "Urology"),
        ("3", "c", 20, 1, 10000.0, "A", 100.0, "Urology"),
        ("4", "c", 20, 3, 8150.0, "C", 90.0, None),
        ("4", "d", 400, 1, 10000.0, "B", 100.0, None),
    ]


def test_states_on_one_side_only(spark):
    payments = spark.createDataFrame(
        [
            ("1", "A", "NY", Decimal(75)),
            ("1", "A", "CA", Decimal(25)),
            ("1", "A", "NYC", Decimal(999)),
            ("1", "A", None, Decimal(999)),
        ],
        "physician_npi string, company_name string, recipient_state string,"
        " payment_amount_usd decimal(14,2)",
    )
    w = Warehouse(
        {
            "fact_payments": payments,
            "fact_prescriptions": rx(spark, ("1", "A", "c", 40), ("2", "A", "c", 60), ("9", "A", "c", 5)),
            "dim_physician": who(spark, ["1"], state="NY").union(who(spark, ["2"], state="TX")),
        }
    )
    got = rows(
        analyses.geographic_market_analysis(w),
        "state",
        "payment_share_pct",
        "prescribing_share_pct",
        "investment_ratio",
        "market_classification",
    )
    assert got == [
        ("CA", 25.0, 0.0, None, "Insufficient data"),
        ("NY", 75.0, 40.0, 1.875, "Over-invested"),
        ("TX", 0.0, 60.0, 0.0, "Under-invested"),
    ]
    market = rows(views.market_map(w), "state", "market_classification")
    assert market == [("CA", "Balanced"), ("NY", "Over-invested"), ("TX", "Under-invested")]


@pytest.mark.parametrize("base", [0, 100_000, 1_000_000])
@pytest.mark.parametrize("slope", [1, -1])
def test_correlation_of_a_line_is_exact_at_any_height(spark, base, slope):
    """Payments that differ by cents: raw sums of squares would lose them."""
    line = [(f"p{i}", "PFIZER", base + 1 + i / 100, 500 + slope * (i % 40), "a") for i in range(40)]
    free = [(f"u{i}", "PFIZER", 0, 3, "a") for i in range(40)]
    w = Warehouse({"fact_payment_prescribing": pairs(spark, *line, *free)})
    assert analyses.payment_prescribing_correlation(w).first().pearson_correlation == slope
    assert views.payment_rx_pearson(w, "PFIZER").first().pearson == slope


def test_noisy_correlation_agrees_with_the_built_in(spark):
    noisy = [(f"p{i}", "PFIZER", 100_000 + (i * 7919 % 1000) / 100, 1 + (i * 31 % 17) + i % 5, "a") for i in range(200)]
    free = [(f"u{i}", "PFIZER", 0, 3, "a") for i in range(40)]
    w = Warehouse({"fact_payment_prescribing": pairs(spark, *noisy, *free)})
    x, y = F.col("total_payment_usd").cast("double"), F.col("company_claim_count").cast("double")
    paid = w.fact_payment_prescribing.where("total_payment_usd > 0")
    expected, own = paid.agg(F.corr(x, y), pearson_of(x, y)).first()
    assert own == pytest.approx(expected, abs=1e-9)
    assert analyses.payment_prescribing_correlation(w).first().pearson_correlation == round(expected, 3)


def test_a_repeated_physician_multiplies_no_money(spark, small):
    twice = Warehouse({**small.tables, "dim_physician": small.dim_physician.unionAll(small.dim_physician)})
    once = small.fact_prescriptions.groupBy("therapeutic_class").agg(F.sum("total_drug_cost_usd").alias("cost"))
    for query in (lambda w: analyses.kol_identification(w, 10_000), lambda w: views.kol_finder(w, rules.THERAPEUTIC_CLASSES[0], n=10_000)):
        single, double = query(small), query(twice)
        cost = "class_drug_cost_usd" if "class_drug_cost_usd" in single.columns else "class_drug_cost"
        assert double.count() == 2 * single.count()
        assert double.agg(F.sum(cost)).first()[0] == 2 * single.agg(F.sum(cost)).first()[0]
    assert once.count() > 0


def test_paid_physicians_are_distinct(spark, small):
    pair = small.fact_payment_prescribing
    twice = Warehouse({**small.tables, "fact_payment_prescribing": pair.unionAll(pair)})
    shown = ["company_name", "physicians_paid"]
    assert rows(analyses.company_spend_efficiency(twice), *shown) == rows(analyses.company_spend_efficiency(small), *shown)


def test_loyalty_without_a_least_volume(spark, small):
    assert analyses.physician_loyalty_scoring(small, min_claims=0).count() >= analyses.physician_loyalty_scoring(small).count()


@pytest.mark.parametrize("top", [3, 2000])
def test_leaders_of_any_number(spark, small, top):
    """Ties at the cut go to the lower number, and rows below the cut are dropped before the class meets."""
    found = rows(analyses.kol_identification(small, top), "therapeutic_class", "rank_in_class", "physician_npi")
    volume = (
        small.fact_prescriptions.groupBy("therapeutic_class", "physician_npi")
        .agg(F.sum("total_claim_count").alias("n"))
        .join(small.dim_physician.select("physician_npi"), "physician_npi")
        .collect()
    )
    expected = []
    for name in {r.therapeutic_class for r in volume}:
        ordered = sorted((r for r in volume if r.therapeutic_class == name), key=lambda r: (r.n is None, -(r.n or 0), r.physician_npi))
        expected += [(name, i, r.physician_npi) for i, r in enumerate(ordered[:top], 1)]
    assert found == sorted(expected, key=repr)

"""The registered queries as DuckDB statements over the same tables.

Written from the meaning of each query, not from its Spark plan: rules are
joined as tables, ranks and shares are plain windows, medians and correlation
are the engine's own aggregates. Quotients of exact sums are rounded in
integer arithmetic, so that a value on a boundary rounds away from zero.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from scriptledger.functions import rules
from scriptledger.registry import CLASS, COMPANY, SPECIALTY, STATES
from scriptledger.sources import driver_tables as given


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(row) + ")" for row in rows)


def _listed(names: list[str | None]) -> str:
    return _values([(str(place), _text(name)) for place, name in enumerate(names)])


def _in(names: list[str]) -> str:
    return "(" + ", ".join(map(_text, names)) + ")"


def _rule_rows(listed: list[tuple[str, list[str]]]) -> str:
    flat = [(label, pattern) for label, patterns in listed for pattern in patterns]
    return _values(
        [(str(i), _text(label), _text(pattern)) for i, (label, pattern) in enumerate(flat)]
    )


def _cents(amount: str) -> str:
    return f"CAST(({amount}) * 100 AS HUGEINT)"


def _rounded(numerator: str, denominator: str, digits: int) -> str:
    """numerator / denominator of non-negative integers, half away from zero."""
    up, down = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    scale = 10**digits
    return (
        f"(CAST((2 * {scale} * {up} + {down}) // nullif(2 * {down}, 0) AS DOUBLE)"
        f" / {scale}::DOUBLE)"
    )


_STATE = (
    "CASE c_nationkey WHEN 24 THEN NULL WHEN 23 THEN 'FOR'"
    " ELSE chr(65 + c_nationkey) || 's' END"
)
_WHOLE = "CASE WHEN regexp_full_match(trim({0}::VARCHAR), '[0-9]+') THEN try_cast(trim({0}::VARCHAR) AS INTEGER) END"
_MONEY = "CASE WHEN regexp_full_match(trim({0}::VARCHAR), '[0-9.]+') THEN try_cast(trim({0}::VARCHAR) AS DECIMAL(14,2)) END"
_NPI = "lpad(trim({0}::VARCHAR), 10, '0')"


def _hash(*columns: str) -> str:
    token = _text(rules.KEY_NULL_TOKEN)
    return "md5(" + " || '-' || ".join(f"coalesce({c}::VARCHAR, {token})" for c in columns) + ")"


def _spend_pivot() -> str:
    return ", ".join(
        f"sum(payment_amount_usd) FILTER (payment_category IN {_in(names)}) AS {column}"
        for column, names in rules.SPEND_COLUMNS.items()
    )


def _kols(where: str = "") -> str:
    return f"""
      SELECT row_number() OVER (ORDER BY v.claims DESC NULLS LAST, p.physician_npi) AS rank,
             p.physician_display_id, p.specialty, p.state,
             v.claims::BIGINT AS class_claims, v.cost AS class_drug_cost,
             coalesce(b.paid_usd, 0) AS total_payments_usd,
             CASE WHEN p.received_pharma_payments THEN '✓' ELSE '—' END AS paid
      FROM (SELECT physician_npi, sum(total_claim_count) AS claims,
                   sum(total_drug_cost_usd) AS cost
            FROM fact_prescriptions WHERE therapeutic_class = {_text(CLASS)} GROUP BY 1) v
      JOIN dim_physician p USING (physician_npi)
      LEFT JOIN (SELECT physician_npi, sum(total_payment_usd) AS paid_usd
                 FROM bridge_physician_company_payments
                 WHERE company_name IN (SELECT company_name FROM fact_prescriptions
                                        WHERE therapeutic_class = {_text(CLASS)})
                 GROUP BY 1) b USING (physician_npi)
      WHERE p.specialty NOT IN {_in(rules.NOT_SPECIALISTS)} {where}
      ORDER BY rank LIMIT 50"""


def _market(company: str | None = None) -> str:
    only = f"AND company_name = {_text(company)}" if company else ""
    return f"""
      SELECT state, coalesce(pay, 0) AS state_payment_usd,
             coalesce(payees, 0) AS paid_physicians,
             coalesce(claims, 0)::BIGINT AS state_claim_count,
             coalesce(cost, 0) AS state_drug_cost_usd,
             coalesce(prescribers, 0) AS prescribing_physicians,
             {_rounded("100 * " + _cents("coalesce(pay, 0)"), _cents("sum(pay) OVER ()"), 3)}
               AS payment_share_pct,
             {_rounded("100 * coalesce(claims, 0)", "sum(claims) OVER ()", 3)}
               AS prescribing_share_pct,
             (coalesce(pay, 0)::DOUBLE * (sum(claims) OVER ())::DOUBLE)
               / nullif(coalesce(claims, 0)::DOUBLE * (sum(pay) OVER ())::DOUBLE, 0)
               AS raw_ratio
      FROM (SELECT recipient_state AS state, sum(payment_amount_usd) AS pay,
                   count(DISTINCT physician_npi) AS payees
            FROM fact_payments
            WHERE recipient_state IS NOT NULL AND length(recipient_state) = 2 {only}
            GROUP BY 1)
      FULL JOIN (SELECT d.state, sum(f.total_claim_count) AS claims,
                        sum(f.total_drug_cost_usd) AS cost,
                        count(DISTINCT f.physician_npi) AS prescribers
                 FROM fact_prescriptions f JOIN dim_physician d USING (physician_npi)
                 WHERE d.state IS NOT NULL AND length(d.state) = 2 {only}
                 GROUP BY 1) USING (state)"""


def _market_class(value: str, null_label: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL THEN '{null_label}' WHEN {value} > 1.25 THEN 'Over-invested'"
        f" WHEN {value} < 0.75 THEN 'Under-invested' ELSE 'Balanced' END"
    )


def _pairs(specialty: str | None = None) -> str:
    only = f" AND specialty = {_text(specialty)}" if specialty else ""
    return (
        "(SELECT * FROM fact_payment_prescribing WHERE company_claim_count > 0"
        f" AND company_name = {_text(COMPANY)}{only})"
    )


_LABEL = (
    "CASE WHEN total_payment_usd > 0 THEN 'Received payments' ELSE 'No payments' END"
)

_CTES: dict[str, str] = {
    # fixed lists
    "payers(i, name)": _listed(given.PAYERS),
    "natures(i, name)": _listed(given.NATURES),
    "raw_specialties(i, name)": _listed(given.SPECIALTIES),
    "classes(i, name)": _listed(rules.THERAPEUTIC_CLASSES),
    "segments(i, name)": _listed(given.SEGMENTS),
    "company_rules(place, label, pattern)": _rule_rows(rules.COMPANY_RULES),
    "category_rules(place, label, pattern)": _rule_rows(rules.CATEGORY_RULES),
    "specialty_rules(place, label, pattern)": _rule_rows(rules.SPECIALTY_RULES),
    "display_names(company_name, shown)": _values(
        [(_text(k), _text(v)) for k, v in rules.COMPANY_DISPLAY_NAMES.items()]
    ),
    # raw tables
    "open_payments": f"""
      SELECT (o_custkey + CASE WHEN o_custkey % 10 = 0 THEN 9000000000 ELSE 0 END)::VARCHAR AS physician_npi,
             payers.name AS company_name,
             CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice::DECIMAL(14,2)
                  WHEN o_orderkey % 53 = 0 THEN 0.50::DECIMAL(14,2)
                  ELSE (round(o_totalprice)::BIGINT / 100::DOUBLE)::DECIMAL(14,2)
             END AS payment_amount_usd,
             o_orderdate::DATE AS payment_date, natures.name AS payment_nature,
             {_STATE} AS recipient_state
      FROM orders JOIN customer ON c_custkey = o_custkey
      JOIN payers ON payers.i = (o_orderkey * 7 + o_custkey) % 25
      JOIN natures ON natures.i = o_orderkey % 18""",
    "part_d_prescribers": f"""
      SELECT (c_custkey + CASE WHEN c_custkey % 10 = 3 OR c_custkey % 20 = 0 THEN 8000000000 ELSE 0 END)::VARCHAR
               AS physician_npi, 'F' || c_custkey AS provider_first_name,
             c_name AS provider_last_name, s.name AS specialty, {_STATE} AS state,
             CASE WHEN c_custkey % 13 = 0 THEN '*'
                  ELSE (5 + (c_custkey * 37) % 3000)::VARCHAR END AS total_claim_count,
             (abs(c_acctbal)::DECIMAL(14,2) * 10)::DECIMAL(14,2) AS total_drug_cost_usd,
             CASE WHEN c_custkey % 11 = 0 THEN NULL
                  ELSE ((5 + (c_custkey * 37) % 3000) // 3)::INTEGER
             END AS total_beneficiary_count
      FROM customer JOIN segments g ON g.name = c_mktsegment
      JOIN raw_specialties s
        ON s.i = CASE WHEN c_custkey % 10 < 8 THEN g.i ELSE 5 + (c_custkey // 10) % 15 END""",
    "part_d_by_drug": """
      SELECT (o_custkey + CASE WHEN o_custkey % 7 = 0 THEN 7000000000 ELSE 0 END)::VARCHAR AS physician_npi,
             CASE WHEN d % 3 = 0 THEN 'DRUG ' || d || ' ' ELSE 'Drug ' || d END
               AS drug_brand_name,
             'generic ' || (d // 2) AS drug_generic_name,
             q::INTEGER AS total_claim_count, c::DECIMAL(14,2) AS total_drug_cost_usd
      FROM (SELECT o_custkey, l_partkey % 64 AS d, sum(l_quantity) AS q,
                   sum(l_extendedprice::DECIMAL(14,2)) AS c
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            GROUP BY ALL)""",
    "drug_company_seed": """
      SELECT 'Drug ' || d AS drug_brand_name, 'generic ' || (d // 2) AS drug_generic_name,
             coalesce(arg_min(r.label, r.place), upper(trim(p.name)))
               AS manufacturer_canonical,
             c.name AS therapeutic_class
      FROM (SELECT DISTINCT p_partkey % 64 AS d FROM part)
      JOIN payers p ON p.i = d % 25 JOIN classes c ON c.i = d % 9
      LEFT JOIN company_rules r ON upper(trim(p.name)) LIKE r.pattern
      WHERE d < 60 GROUP BY d, p.name, c.name""",
    # canonical names of the raw values that occur
    "company_names": """
      SELECT raw, coalesce(arg_min(label, place), upper(trim(raw))) AS canonical
      FROM (SELECT DISTINCT company_name AS raw FROM open_payments)
      LEFT JOIN company_rules ON upper(trim(raw)) LIKE pattern GROUP BY raw""",
    "category_names": """
      SELECT raw, coalesce(arg_min(label, place), 'Other') AS canonical
      FROM (SELECT DISTINCT payment_nature AS raw FROM open_payments)
      LEFT JOIN category_rules ON raw ILIKE pattern GROUP BY raw""",
    "specialty_names": """
      SELECT raw, coalesce(arg_min(label, place), trim(raw), 'Unknown') AS canonical
      FROM (SELECT DISTINCT specialty AS raw FROM part_d_prescribers)
      LEFT JOIN specialty_rules ON raw ILIKE pattern GROUP BY raw""",
    # staging
    "stg_open_payments": f"""
      SELECT {_hash("physician_npi", "company_name", "payment_date", "payment_amount_usd", "payment_nature")}
               AS payment_id,
             {_NPI.format("physician_npi")} AS physician_npi,
             company_names.canonical AS company_name, payment_amount_usd, payment_date,
             category_names.canonical AS payment_category,
             upper(trim(recipient_state)) AS recipient_state
      FROM open_payments JOIN company_names ON company_names.raw = company_name
      JOIN category_names ON category_names.raw IS NOT DISTINCT FROM payment_nature
      WHERE physician_npi IS NOT NULL AND payment_amount_usd >= 1.00""",
    "stg_part_d_prescribers": f"""
      SELECT {_NPI.format("physician_npi")} AS physician_npi,
             trim(provider_first_name) AS provider_first_name,
             trim(provider_last_name) AS provider_last_name,
             canonical AS specialty, upper(trim(state)) AS state,
             {_WHOLE.format("total_claim_count")} AS total_claim_count,
             {_MONEY.format("total_drug_cost_usd")} AS total_drug_cost_usd,
             {_WHOLE.format("total_beneficiary_count")} AS total_beneficiary_count
      FROM part_d_prescribers JOIN specialty_names ON raw IS NOT DISTINCT FROM specialty""",
    "stg_part_d_by_drug": f"""
      SELECT {_NPI.format("physician_npi")} AS physician_npi,
             trim(drug_brand_name) AS drug_brand_name,
             trim(drug_generic_name) AS drug_generic_name,
             {_WHOLE.format("total_claim_count")} AS total_claim_count,
             {_MONEY.format("total_drug_cost_usd")} AS total_drug_cost_usd
      FROM part_d_by_drug
      WHERE physician_npi IS NOT NULL AND drug_brand_name IS NOT NULL""",
    # intermediate
    "int_drug_company_mapping": """
      SELECT upper(trim(drug_brand_name)) AS drug_brand_name_upper,
             trim(drug_brand_name) AS drug_brand_name,
             trim(drug_generic_name) AS drug_generic_name,
             upper(trim(manufacturer_canonical)) AS company_name, therapeutic_class
      FROM drug_company_seed""",
    "int_physician_payments_agg": f"""
      SELECT physician_npi, company_name, sum(payment_amount_usd) AS total_payment_usd,
             count(*) AS payment_count, {_spend_pivot()},
             max(payment_amount_usd) AS max_single_payment_usd,
             min(payment_date) AS first_payment_date, max(payment_date) AS last_payment_date
      FROM stg_open_payments GROUP BY ALL""",
    "fact_prescriptions": """
      SELECT p.physician_npi, p.drug_brand_name, m.company_name, m.therapeutic_class,
             p.total_claim_count, p.total_drug_cost_usd
      FROM stg_part_d_by_drug p JOIN int_drug_company_mapping m
        ON upper(trim(p.drug_brand_name)) = m.drug_brand_name_upper""",
    "int_physician_drug_prescribing": """
      SELECT physician_npi, company_name,
             sum(total_claim_count)::BIGINT AS company_claim_count,
             sum(total_drug_cost_usd) AS company_drug_cost_usd,
             count(DISTINCT drug_brand_name) AS distinct_drugs_prescribed,
             string_agg(DISTINCT drug_brand_name, ', ' ORDER BY drug_brand_name)
               AS drugs_prescribed_list
      FROM fact_prescriptions GROUP BY ALL""",
    # mart
    "paid_states": """
      SELECT physician_npi, recipient_state AS state
      FROM (SELECT physician_npi, recipient_state, count(*) AS n FROM stg_open_payments
            WHERE recipient_state IS NOT NULL GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY physician_npi ORDER BY n DESC, state) = 1""",
    "all_physicians": """
      SELECT physician_npi, specialty, state, total_claim_count, total_drug_cost_usd,
             total_beneficiary_count, true AS is_part_d_prescriber
      FROM stg_part_d_prescribers
      UNION ALL
      SELECT physician_npi, 'Unknown', s.state, NULL, NULL, NULL, false
      FROM (SELECT DISTINCT physician_npi FROM stg_open_payments) p
      ANTI JOIN stg_part_d_prescribers USING (physician_npi)
      LEFT JOIN paid_states s USING (physician_npi)""",
    "dim_physician": f"""
      SELECT physician_npi,
             'Physician #' || lpad((('0x' || substr(md5(physician_npi), 1, 4))::INTEGER)::VARCHAR,
                                   4, '0') AS physician_display_id,
             specialty, state, total_claim_count, total_drug_cost_usd, total_beneficiary_count,
             CASE WHEN total_claim_count = 0 THEN 0
                  ELSE {_rounded(_cents("total_drug_cost_usd"), "100 * total_claim_count", 2)}
             END AS avg_cost_per_claim_usd,
             is_part_d_prescriber,
             physician_npi IN (SELECT physician_npi FROM stg_open_payments)
               AS received_pharma_payments
      FROM all_physicians""",
    "dim_company": """
      SELECT company_name,
             coalesce(shown, array_to_string(list_transform(
               regexp_extract_all(lower(company_name), '[a-z0-9]+|[^a-z0-9]+'),
               lambda x: upper(x[1]) || x[2:]), '')) AS company_display_name,
             coalesce(drugs, 0) AS drugs_in_portfolio,
             coalesce(areas, 'N/A') AS therapeutic_areas
      FROM (SELECT company_name FROM stg_open_payments
            UNION SELECT company_name FROM int_drug_company_mapping)
      LEFT JOIN display_names USING (company_name)
      LEFT JOIN (SELECT company_name, count(DISTINCT drug_brand_name) AS drugs,
                        string_agg(DISTINCT therapeutic_class, ', ' ORDER BY therapeutic_class)
                          AS areas
                 FROM int_drug_company_mapping GROUP BY 1) USING (company_name)""",
    "dim_drug": f"""
      SELECT {_hash("drug_brand_name", "company_name")} AS drug_key, drug_brand_name,
             drug_generic_name, company_name, therapeutic_class
      FROM int_drug_company_mapping""",
    "fact_payments": """
      SELECT *, year(payment_date)::INTEGER AS payment_year,
             quarter(payment_date)::INTEGER AS payment_quarter,
             month(payment_date)::INTEGER AS payment_month,
             CASE WHEN payment_amount_usd >= 100000 THEN '> $100K'
                  WHEN payment_amount_usd >= 10000 THEN '$10K – $100K'
                  WHEN payment_amount_usd >= 1000 THEN '$1K – $10K'
                  WHEN payment_amount_usd >= 100 THEN '$100 – $1K'
                  ELSE '< $100' END AS payment_size_bucket
      FROM stg_open_payments""",
    "bridge_physician_company_payments": """
      SELECT physician_npi, company_name, total_payment_usd, payment_count,
             max_single_payment_usd
      FROM int_physician_payments_agg""",
    "fact_payment_prescribing": """
      SELECT physician_npi, company_name,
             coalesce(total_payment_usd, 0) AS total_payment_usd,
             coalesce(payment_count, 0) AS payment_count,
             coalesce(max_single_payment_usd, 0) AS max_single_payment_usd,
             coalesce(company_claim_count, 0) AS company_claim_count,
             coalesce(company_drug_cost_usd, 0) AS company_drug_cost_usd,
             coalesce(distinct_drugs_prescribed, 0) AS distinct_drugs_prescribed,
             CASE WHEN total_payment_usd IS NULL AND company_claim_count IS NULL THEN 'neither'
                  WHEN total_payment_usd IS NULL THEN 'rx_no_payment'
                  WHEN company_claim_count IS NULL THEN 'paid_no_rx'
                  ELSE 'paid_and_prescribed' END AS relationship_type,
             d.specialty, d.state
      FROM int_physician_payments_agg
      FULL JOIN int_physician_drug_prescribing USING (physician_npi, company_name)
      LEFT JOIN dim_physician d USING (physician_npi)""",
    # shared by several statements
    "specialty_spend": """
      SELECT specialty, company_name, sum(payment_amount_usd) AS spend
      FROM fact_payments JOIN dim_physician USING (physician_npi)
      WHERE specialty IS NOT NULL AND specialty <> 'Unknown' GROUP BY ALL""",
    "top_specialties": f"""
      SELECT specialty, {_rounded(_cents("sum(spend)"), "100000000", 2)} AS spend_millions
      FROM specialty_spend GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
    "company_categories": f"""
      SELECT payment_category, {_rounded(_cents("sum(payment_amount_usd)"), "100000", 1)} AS spend_k
      FROM fact_payments WHERE company_name = {_text(COMPANY)} GROUP BY 1""",
    "company_leaders": f"""
      SELECT physician_display_id, specialty, state, sum(payment_amount_usd) AS total_paid,
             count(*) AS payment_count, max(payment_amount_usd) AS largest_single
      FROM fact_payments JOIN dim_physician USING (physician_npi)
      WHERE company_name = {_text(COMPANY)} GROUP BY 1, 2, 3
      ORDER BY total_paid DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 25""",
    "kols": _kols(),
    "market": _market(),
    "company_market": _market(COMPANY),
    "market_map": f"""
      SELECT state, state_payment_usd, paid_physicians, state_claim_count, state_drug_cost_usd,
             payment_share_pct, prescribing_share_pct, round(raw_ratio, 3) AS investment_ratio,
             {_market_class("raw_ratio", "Balanced")} AS market_classification
      FROM market""",
    "market_map_company": f"""
      SELECT state, state_payment_usd, paid_physicians, state_claim_count, state_drug_cost_usd,
             payment_share_pct, prescribing_share_pct, round(raw_ratio, 3) AS investment_ratio,
             {_market_class("raw_ratio", "Balanced")} AS market_classification
      FROM company_market""",
}


def _correlation(min_n: int) -> str:
    varies = "min({0}) FILTER (paid) < max({0}) FILTER (paid)"
    return f"""
      SELECT specialty, company_name, n_paid, n_unpaid,
             {_rounded("claims_paid", "n_paid", 1)} AS avg_claims_paid,
             round(median_paid, 1) AS median_claims_paid,
             {_rounded("claims_unpaid", "n_unpaid", 1)} AS avg_claims_unpaid,
             round(median_unpaid, 1) AS median_claims_unpaid,
             round((claims_paid::DOUBLE / n_paid) / (claims_unpaid::DOUBLE / n_unpaid), 2)
               AS lift_ratio,
             round(r, 3) + 0.0::DOUBLE AS pearson_correlation
      FROM (SELECT specialty, company_name,
                   count(*) FILTER (paid) AS n_paid, count(*) FILTER (NOT paid) AS n_unpaid,
                   sum(claims) FILTER (paid) AS claims_paid,
                   sum(claims) FILTER (NOT paid) AS claims_unpaid,
                   quantile_cont(claims, 0.5) FILTER (paid) AS median_paid,
                   quantile_cont(claims, 0.5) FILTER (NOT paid) AS median_unpaid,
                   CASE WHEN {varies.format("usd")} AND {varies.format("claims")}
                        THEN corr(usd, claims) FILTER (paid) END AS r
            FROM (SELECT specialty, company_name, total_payment_usd > 0 AS paid,
                         total_payment_usd::DOUBLE AS usd, company_claim_count AS claims
                  FROM fact_payment_prescribing
                  WHERE specialty IS NOT NULL AND specialty <> 'Unknown'
                    AND company_claim_count > 0)
            GROUP BY ALL)
      WHERE n_paid >= {min_n} AND n_unpaid >= {min_n}"""


def _group_summary(specialty: str | None = None) -> str:
    return f"""
      SELECT {_LABEL} AS group_label, count(*) AS n_physicians,
             {_rounded("sum(company_claim_count)", "count(*)", 1)} AS avg_claims,
             round(quantile_cont(company_claim_count, 0.5), 1) AS median_claims,
             sum(company_claim_count)::BIGINT AS total_claims
      FROM {_pairs(specialty)} GROUP BY 1"""


def _lift(specialty: str | None = None) -> str:
    return f"""
      SELECT max(avg_claims) FILTER (group_label = 'Received payments') AS avg_claims_paid,
             max(avg_claims) FILTER (group_label = 'No payments') AS avg_claims_unpaid,
             {_rounded("round(10 * avg_claims_paid)", "round(10 * avg_claims_unpaid)", 2)}
               AS lift_ratio
      FROM ({_group_summary(specialty)})"""


def _points(specialty: str | None = None) -> str:
    return (
        "SELECT total_payment_usd, company_claim_count, specialty, state"
        f" FROM {_pairs(specialty)} WHERE total_payment_usd > 0"
    )


def _pearson(specialty: str | None = None) -> str:
    return f"""
      SELECT count(*) AS n_points,
             CASE WHEN count(*) >= 10 AND min(total_payment_usd) < max(total_payment_usd)
                       AND min(company_claim_count) < max(company_claim_count)
                  THEN round(corr(total_payment_usd::DOUBLE, company_claim_count), 3) + 0.0::DOUBLE
             END AS pearson
      FROM ({_points(specialty)})"""


def _display_options(source: str) -> str:
    return (
        "SELECT DISTINCT company_name, coalesce(company_display_name, company_name)"
        f" AS display_name FROM {source} LEFT JOIN dim_company USING (company_name)"
    )


def _leaders(market: str, label: str) -> str:
    return f"""
      SELECT state, investment_ratio, payment_share_pct, prescribing_share_pct
      FROM {market} WHERE market_classification = '{label}'
      ORDER BY state_claim_count DESC, state LIMIT 10"""


def _report() -> str:
    """The 57 checks, each as its own statement."""
    lines = []

    def add(table: str, column: str, test: str, failures: str) -> None:
        lines.append(
            f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{test}' AS test,"
            f" ({failures})::BIGINT AS failures"
        )

    def not_null(table: str, columns: str) -> None:
        for column in columns.split():
            add(table, column, "not_null", f"SELECT count(*) FROM {table} WHERE {column} IS NULL")

    def unique(table: str, column: str) -> None:
        repeated = f"SELECT {column} FROM {table} GROUP BY 1 HAVING count({column}) > 1"
        add(table, column, "unique", f"SELECT count(*) FROM ({repeated})")

    def between(table: str, column: str, broken: str) -> None:
        add(table, column, "between", f"SELECT count(*) FROM {table} WHERE {column} {broken}")

    def accepted(table: str, column: str, values: str) -> None:
        outside = f"{column} NOT IN {values}"
        add(
            table,
            column,
            "accepted_values",
            f"SELECT count(DISTINCT {column}) FROM {table} WHERE {outside}",
        )

    def refers(table: str, column: str, parent: str) -> None:
        known = f"SELECT {column} FROM {parent}"
        add(
            table,
            column,
            "relationships",
            f"SELECT count({column}) FROM {table} WHERE {column} NOT IN ({known})",
        )

    not_null("open_payments", "physician_npi company_name payment_amount_usd")
    between("open_payments", "payment_amount_usd", "NOT BETWEEN 0 AND 100000000")
    not_null("part_d_prescribers", "physician_npi total_claim_count")
    unique("part_d_prescribers", "physician_npi")
    not_null("part_d_by_drug", "physician_npi total_claim_count")
    not_null("stg_open_payments", "payment_id physician_npi company_name payment_amount_usd")
    between("stg_open_payments", "payment_amount_usd", "< 1")
    accepted("stg_open_payments", "payment_category", _in(rules.CATEGORIES))
    not_null("stg_part_d_prescribers", "physician_npi specialty")
    unique("stg_part_d_prescribers", "physician_npi")
    not_null("stg_part_d_by_drug", "physician_npi drug_brand_name")
    not_null("int_physician_payments_agg", "physician_npi company_name total_payment_usd")
    between("int_physician_payments_agg", "total_payment_usd", "< 0")
    not_null("int_drug_company_mapping", "drug_brand_name_upper company_name")
    unique("int_drug_company_mapping", "drug_brand_name_upper")
    not_null("int_physician_drug_prescribing", "physician_npi company_name company_claim_count")
    not_null(
        "dim_physician",
        "physician_npi physician_display_id specialty is_part_d_prescriber"
        " received_pharma_payments",
    )
    unique("dim_physician", "physician_npi")
    accepted("dim_physician", "is_part_d_prescriber", "(true, false)")
    accepted("dim_physician", "received_pharma_payments", "(true, false)")
    not_null("dim_company", "company_name")
    unique("dim_company", "company_name")
    not_null("dim_drug", "drug_key therapeutic_class")
    unique("dim_drug", "drug_key")
    not_null("fact_payments", "payment_id physician_npi company_name")
    refers("fact_payments", "physician_npi", "dim_physician")
    refers("fact_payments", "company_name", "dim_company")
    not_null("fact_prescriptions", "physician_npi")
    not_null("fact_payment_prescribing", "physician_npi company_name relationship_type")
    accepted("fact_payment_prescribing", "relationship_type", _in(rules.RELATIONSHIP_TYPES))
    not_null("drug_company_seed", "drug_brand_name manufacturer_canonical therapeutic_class")
    accepted("drug_company_seed", "therapeutic_class", _in(rules.THERAPEUTIC_CLASSES))
    return f"SELECT *, failures = 0 AS passed FROM ({' UNION ALL '.join(lines)})"


_PREFIXES = "'^(" + "|".join(rules.LOAD_COMPANY_PREFIXES) + ")'"
_FRAGMENTS = "'" + "|".join(rules.LOAD_SPECIALTY_FRAGMENTS) + "'"

_MODELS = [
    "stg_open_payments",
    "stg_part_d_prescribers",
    "stg_part_d_by_drug",
    "int_drug_company_mapping",
    "int_physician_payments_agg",
    "int_physician_drug_prescribing",
    "dim_physician",
    "dim_company",
    "dim_drug",
    "fact_payments",
    "fact_prescriptions",
    "fact_payment_prescribing",
    "bridge_physician_company_payments",
]

_STATEMENTS: dict[str, str] = {
    "load_open_payments": f"""
      SELECT * FROM open_payments
      WHERE regexp_matches(upper(company_name), {_PREFIXES}) AND payment_amount_usd >= 50""",
    "load_part_d_prescribers": f"""
      SELECT * REPLACE (total_claim_count::INTEGER AS total_claim_count)
      FROM part_d_prescribers
      WHERE regexp_matches(lower(specialty), {_FRAGMENTS})
        AND try_cast(total_claim_count AS INTEGER) >= 10""",
    "load_part_d_by_drug": """
      SELECT * FROM part_d_by_drug
      WHERE upper(trim(drug_brand_name)) IN (SELECT upper(drug_brand_name) FROM drug_company_seed)""",
    **{name: f"SELECT * FROM {name}" for name in _MODELS},
    "canonical_company": """
      SELECT company_name, canonical AS canonical_company, count(*) AS n
      FROM open_payments JOIN company_names ON raw = company_name GROUP BY ALL""",
    "payment_category": """
      SELECT payment_nature, canonical AS payment_category, count(*) AS n
      FROM open_payments JOIN category_names ON raw IS NOT DISTINCT FROM payment_nature
      GROUP BY ALL""",
    "canonical_specialty": """
      SELECT specialty, canonical AS canonical_specialty, count(*) AS n
      FROM part_d_prescribers JOIN specialty_names ON raw IS NOT DISTINCT FROM specialty
      GROUP BY ALL""",
    "display_id": "SELECT physician_npi, physician_display_id FROM dim_physician",
    "payment_size_bucket": """
      SELECT payment_size_bucket, count(*) AS n, sum(payment_amount_usd) AS amount_usd
      FROM fact_payments GROUP BY 1""",
    "kol_identification": f"""
      SELECT therapeutic_class,
             CASE WHEN pr >= 0.99 THEN 'A — Top 1%' WHEN pr >= 0.95 THEN 'B — Top 5%'
                  WHEN pr >= 0.90 THEN 'C — Top 10%' ELSE 'D — Below top decile' END AS kol_tier,
             rn AS rank_in_class, physician_npi, physician_display_id, specialty, state,
             claims AS class_claim_count, cost AS class_drug_cost_usd,
             {_rounded("100 * running", "total", 2)} AS cumulative_share_pct
      FROM (SELECT *, row_number() OVER ranked AS rn,
                   sum(claims) OVER (ranked ROWS UNBOUNDED PRECEDING) AS running,
                   sum(claims) OVER (PARTITION BY therapeutic_class) AS total,
                   percent_rank() OVER (PARTITION BY therapeutic_class
                                        ORDER BY claims NULLS LAST) AS pr
            FROM (SELECT physician_npi, therapeutic_class,
                         sum(total_claim_count)::BIGINT AS claims,
                         sum(total_drug_cost_usd) AS cost
                  FROM fact_prescriptions GROUP BY ALL)
            JOIN dim_physician USING (physician_npi)
            WINDOW ranked AS (PARTITION BY therapeutic_class
                              ORDER BY claims DESC NULLS LAST, physician_npi))
      WHERE rn <= 100""",
    "payment_prescribing_correlation": _correlation(30),
    "payment_prescribing_correlation_min3": _correlation(3),
    "company_spend_efficiency": f"""
      SELECT company_name, spend AS total_spend_usd, payees AS physicians_paid,
             claims::BIGINT AS claims_from_paid, revenue AS drug_revenue_from_paid_usd,
             unpaid::BIGINT AS claims_from_unpaid,
             {_rounded(_cents("spend"), "100 * payees", 2)} AS avg_spend_per_paid_physician,
             {_rounded("100000 * claims", _cents("spend"), 2)} AS claims_per_1k_spend,
             {_rounded(_cents("revenue"), _cents("spend"), 2)} AS rx_dollar_per_payment_dollar,
             {_rounded("100 * claims", "claims + unpaid", 2)} AS paid_share_of_total_rx_pct
      FROM (SELECT company_name, sum(total_payment_usd) AS spend,
                   count(DISTINCT physician_npi) FILTER (total_payment_usd > 0) AS payees,
                   sum(company_claim_count) FILTER (total_payment_usd > 0) AS claims,
                   sum(company_drug_cost_usd) FILTER (total_payment_usd > 0) AS revenue,
                   sum(company_claim_count) FILTER (total_payment_usd = 0) AS unpaid
            FROM fact_payment_prescribing GROUP BY 1)
      WHERE spend > 0""",
    "geographic_market_analysis": f"""
      SELECT * EXCLUDE (raw_ratio), round(raw_ratio, 3) AS investment_ratio,
             {_market_class("round(raw_ratio, 3)", "Insufficient data")} AS market_classification
      FROM market""",
    "physician_loyalty_scoring": f"""
      SELECT physician_npi, physician_display_id, specialty, state, therapeutic_class,
             total AS total_claims, n AS distinct_companies, hhi AS hhi_score,
             CASE WHEN hhi >= 9000 THEN 'Loyalist (single source)'
                  WHEN hhi >= 5000 THEN 'Strong preference'
                  WHEN hhi >= 2500 THEN 'Mixed prescriber'
                  ELSE 'Highly diversified' END AS loyalty_segment,
             first_company AS dominant_company,
             {_rounded("100 * most", "total", 1)} AS dominant_share_pct
      FROM (SELECT physician_npi, therapeutic_class, max(total)::BIGINT AS total,
                   count(DISTINCT company_name) AS n, max(claims) AS most,
                   {_rounded("10000 * sum(claims * claims)", "max(total) * max(total)", 0)} AS hhi,
                   max(company_name) FILTER (place = 1) AS first_company
            FROM (SELECT *, sum(claims) OVER (PARTITION BY physician_npi, therapeutic_class)
                              AS total,
                         row_number() OVER (PARTITION BY physician_npi, therapeutic_class
                                            ORDER BY claims DESC NULLS LAST, company_name)
                              AS place
                  FROM (SELECT physician_npi, therapeutic_class, company_name,
                               sum(total_claim_count) AS claims
                        FROM fact_prescriptions GROUP BY ALL))
            GROUP BY ALL)
      LEFT JOIN dim_physician USING (physician_npi)
      WHERE total >= 20""",
    "dashboard_kpis": """
      SELECT (SELECT sum(payment_amount_usd) FROM fact_payments) AS total_payments,
             (SELECT count(*) FROM fact_payments) AS payment_count,
             (SELECT count(DISTINCT company_name) FROM fact_payments) AS companies,
             (SELECT count(DISTINCT physician_npi) FROM fact_payments) AS paid_physicians""",
    "spend_by_company": f"""
      SELECT coalesce(company_display_name, company_name) AS company,
             {_rounded(_cents("sum(payment_amount_usd)"), "100000000", 2)} AS spend_millions
      FROM fact_payments LEFT JOIN dim_company USING (company_name) GROUP BY 1""",
    "spend_by_category": f"""
      SELECT payment_category,
             {_rounded(_cents("sum(payment_amount_usd)"), "100000000", 2)} AS spend_millions
      FROM fact_payments GROUP BY 1""",
    "spend_by_specialty": "SELECT * FROM top_specialties",
    "paid_vs_unpaid_claims": f"""
      SELECT CASE WHEN received_pharma_payments THEN 'Received payments'
                  ELSE 'No payments' END AS group_label,
             count(*) AS n_physicians,
             {_rounded("sum(total_claim_count)", "count(*)", 0)} AS avg_claims
      FROM dim_physician WHERE total_claim_count IS NOT NULL GROUP BY 1""",
    "therapeutic_class_options": "SELECT DISTINCT therapeutic_class FROM fact_prescriptions",
    "state_options": "SELECT DISTINCT state FROM dim_physician WHERE length(state) = 2",
    "kol_finder": "SELECT * FROM kols",
    "kol_finder_states": _kols(f"AND p.state IN {_in(STATES)}"),
    "kol_finder_paid": _kols("AND p.received_pharma_payments"),
    "kol_finder_unpaid": _kols("AND NOT p.received_pharma_payments"),
    "kol_points": "SELECT * FROM kols WHERE total_payments_usd > 0",
    "kol_display_table": """
      SELECT rank, physician_display_id, specialty, state,
             format('{:,}', class_claims) AS class_claims,
             '$' || format('{:,.0f}', class_drug_cost::DOUBLE) AS class_drug_cost,
             '$' || format('{:,.0f}', total_payments_usd::DOUBLE) AS total_payments_usd, paid
      FROM kols""",
    "company_options": f"""
      SELECT company_name, display_name, total_m,
             display_name || ' ($' || total_m::VARCHAR || 'M)' AS label
      FROM (SELECT company_name, coalesce(company_display_name, company_name) AS display_name,
                   {_rounded(_cents("sum(payment_amount_usd)"), "100000000", 1)} AS total_m
            FROM fact_payments LEFT JOIN dim_company USING (company_name) GROUP BY ALL)""",
    "company_kpis": f"""
      SELECT sum(payment_amount_usd) AS total_spend, count(*) AS n_payments,
             count(DISTINCT physician_npi) AS physicians_paid,
             sum(payment_amount_usd)::DOUBLE / count(*)::DOUBLE AS avg_payment
      FROM fact_payments WHERE company_name = {_text(COMPANY)}""",
    "company_specialty_mix": f"""
      SELECT specialty, {_rounded(_cents("spend"), "100000", 1)} AS spend_k
      FROM specialty_spend WHERE company_name = {_text(COMPANY)}
      ORDER BY 2 DESC, 1 LIMIT 10""",
    "company_category_mix": "SELECT * FROM company_categories",
    "company_geography": f"""
      SELECT recipient_state AS state,
             {_rounded(_cents("sum(payment_amount_usd)"), "100000", 1)} AS spend_k,
             count(DISTINCT physician_npi) AS physicians
      FROM fact_payments
      WHERE company_name = {_text(COMPANY)} AND length(recipient_state) = 2 GROUP BY 1""",
    "company_top_physicians": "SELECT * FROM company_leaders",
    "company_display_table": """
      SELECT * REPLACE ('$' || format('{:,.0f}', total_paid::DOUBLE) AS total_paid,
                        '$' || format('{:,.0f}', largest_single::DOUBLE) AS largest_single)
      FROM company_leaders""",
    "company_top_physicians_by_npi": f"""
      SELECT physician_npi, physician_display_id, specialty, state,
             sum(payment_amount_usd) AS total_paid,
             count(*) AS payment_count, max(payment_amount_usd) AS largest_single
      FROM fact_payments JOIN dim_physician USING (physician_npi)
      WHERE company_name = {_text(COMPANY)} GROUP BY 1, 2, 3, 4
      ORDER BY total_paid DESC, physician_npi LIMIT 25""",
    "paid_rx_company_options": _display_options(
        "(SELECT * FROM fact_payment_prescribing"
        " WHERE total_payment_usd > 0 AND company_claim_count > 0)"
    ),
    "specialty_options": """
      SELECT DISTINCT specialty FROM fact_payment_prescribing WHERE specialty <> 'Unknown'""",
    "payment_group_summary": _group_summary(),
    "payment_group_summary_specialty": _group_summary(SPECIALTY),
    "lift_ratio": _lift(),
    "lift_ratio_specialty": _lift(SPECIALTY),
    "payment_rx_points": _points(),
    "payment_rx_points_specialty": _points(SPECIALTY),
    "payment_rx_pearson": _pearson(),
    "payment_rx_pearson_specialty": _pearson(SPECIALTY),
    "market_company_options": _display_options("fact_payments"),
    "market_map": "SELECT * FROM market_map",
    "market_map_company": "SELECT * FROM market_map_company",
    "under_invested": _leaders("market_map", "Under-invested"),
    "under_invested_company": _leaders("market_map_company", "Under-invested"),
    "over_invested": _leaders("market_map", "Over-invested"),
    "over_invested_company": _leaders("market_map_company", "Over-invested"),
    "filter_options": """
      SELECT DISTINCT payment_category FROM fact_payments
      WHERE payment_category IS NOT NULL ORDER BY 1 LIMIT 200""",
    "share_of_total": """
      SELECT payment_category, spend_k, share_pct,
             CASE WHEN share_pct >= 5 THEN format('{}<br>{:.1f}%', payment_category, share_pct)
                  ELSE '' END AS label
      FROM (SELECT *, spend_k / sum(spend_k::DECIMAL(18,1)) OVER ()::DOUBLE * 100 AS share_pct
            FROM company_categories)""",
    "result_profile": """
      SELECT 'spend_millions' AS column_name, count(spend_millions) AS count,
             round(avg(spend_millions), 2) AS mean, round(stddev_samp(spend_millions), 2) AS std,
             round(min(spend_millions), 2) AS min,
             round(quantile_cont(spend_millions, 0.25), 2) AS p25,
             round(quantile_cont(spend_millions, 0.5), 2) AS p50,
             round(quantile_cont(spend_millions, 0.75), 2) AS p75,
             round(max(spend_millions), 2) AS max
      FROM top_specialties""",
    "result_first_and_last": """
      SELECT CASE WHEN n <= 8 OR up <= 4 THEN 'head' ELSE 'tail' END AS part,
             (CASE WHEN n <= 8 OR up <= 4 THEN up ELSE n + 1 - up END) AS place,
             n AS n_rows, specialty, spend_millions
      FROM (SELECT *, count(*) OVER () AS n,
                   row_number() OVER (ORDER BY spend_millions, specialty) AS up
            FROM top_specialties)
      WHERE n <= 8 OR up <= 4 OR up > n - 4""",
    "dq_not_null": "SELECT * FROM fact_payment_prescribing WHERE specialty IS NULL",
    "dq_unique": """
      SELECT physician_npi AS value, count(*) AS n_records FROM fact_payments
      GROUP BY 1 HAVING count(*) > 1""",
    "dq_accepted_values": f"""
      SELECT payment_category AS value, count(*) AS n_records FROM stg_open_payments
      WHERE payment_category NOT IN {_in(rules.CATEGORIES[:10])} GROUP BY 1""",
    "dq_relationships": """
      SELECT physician_npi AS value, count(*) AS n_records FROM fact_prescriptions
      WHERE physician_npi NOT IN (SELECT physician_npi FROM dim_physician) GROUP BY 1""",
    "dq_between": """
      SELECT * FROM fact_payments WHERE payment_amount_usd NOT BETWEEN 50 AND 10000""",
    "dq_report": _report(),
}

# Decimal columns, compared as doubles.
_MONEY_COLUMNS: dict[str, list[str]] = {
    "load_open_payments": [
        "payment_amount_usd",
    ],
    "load_part_d_prescribers": [
        "total_drug_cost_usd",
    ],
    "load_part_d_by_drug": [
        "total_drug_cost_usd",
    ],
    "stg_open_payments": [
        "payment_amount_usd",
    ],
    "stg_part_d_prescribers": [
        "total_drug_cost_usd",
    ],
    "stg_part_d_by_drug": [
        "total_drug_cost_usd",
    ],
    "int_physician_payments_agg": [
        "total_payment_usd",
        "spend_food_beverage_usd",
        "spend_consulting_usd",
        "spend_speaking_usd",
        "spend_travel_usd",
        "spend_education_usd",
        "spend_honoraria_usd",
        "spend_royalty_usd",
        "spend_other_usd",
        "max_single_payment_usd",
    ],
    "int_physician_drug_prescribing": [
        "company_drug_cost_usd",
    ],
    "dim_physician": [
        "total_drug_cost_usd",
    ],
    "fact_payments": [
        "payment_amount_usd",
    ],
    "fact_prescriptions": [
        "total_drug_cost_usd",
    ],
    "fact_payment_prescribing": [
        "total_payment_usd",
        "max_single_payment_usd",
        "company_drug_cost_usd",
    ],
    "bridge_physician_company_payments": [
        "total_payment_usd",
        "max_single_payment_usd",
    ],
    "payment_size_bucket": [
        "amount_usd",
    ],
    "kol_identification": [
        "class_drug_cost_usd",
    ],
    "company_spend_efficiency": [
        "total_spend_usd",
        "drug_revenue_from_paid_usd",
    ],
    "geographic_market_analysis": [
        "state_payment_usd",
        "state_drug_cost_usd",
    ],
    "dashboard_kpis": [
        "total_payments",
    ],
    "kol_finder": [
        "class_drug_cost",
        "total_payments_usd",
    ],
    "kol_finder_states": [
        "class_drug_cost",
        "total_payments_usd",
    ],
    "kol_finder_paid": [
        "class_drug_cost",
        "total_payments_usd",
    ],
    "kol_finder_unpaid": [
        "class_drug_cost",
        "total_payments_usd",
    ],
    "kol_points": [
        "class_drug_cost",
        "total_payments_usd",
    ],
    "company_kpis": [
        "total_spend",
    ],
    "company_top_physicians": [
        "total_paid",
        "largest_single",
    ],
    "company_top_physicians_by_npi": [
        "total_paid",
        "largest_single",
    ],
    "payment_rx_points": [
        "total_payment_usd",
    ],
    "payment_rx_points_specialty": [
        "total_payment_usd",
    ],
    "market_map": [
        "state_payment_usd",
        "state_drug_cost_usd",
    ],
    "market_map_company": [
        "state_payment_usd",
        "state_drug_cost_usd",
    ],
    "dq_not_null": [
        "total_payment_usd",
        "max_single_payment_usd",
        "company_drug_cost_usd",
    ],
    "dq_between": [
        "payment_amount_usd",
    ],
}


def _with_ctes(body: str, given: Collection[str]) -> str:
    """The statement behind the CTEs it needs, and those they need."""
    heads = {head.split("(")[0]: head for head in _CTES}
    needed, queue = set(), [body]
    while queue:
        sql = queue.pop()
        for name in set(heads) - needed - set(given):
            if re.search(rf"\b{name}\b", sql):
                needed.add(name)
                queue.append(_CTES[heads[name]])
    parts = [f"{head} AS ({_CTES[head]})" for name, head in heads.items() if name in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _as_doubles(body: str, columns: list[str]) -> str:
    if not columns:
        return body
    casts = ", ".join(f"{column}::DOUBLE AS {column}" for column in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({body})"


def statements(given: Collection[str] = ()) -> dict[str, str]:
    """Every statement by query name. Tables named in ``given`` are taken from
    the database instead of derived from the driver tables."""
    return {
        name: _with_ctes(_as_doubles(body, _MONEY_COLUMNS.get(name, [])), given)
        for name, body in _STATEMENTS.items()
    }

"""The five analyses over the mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptledger.functions import columns as C
from scriptledger.functions import rules
from scriptledger.functions.ratios import double_ratio, money_sum, pearson, percentage, ratio
from scriptledger.operators import ranking
from scriptledger.operators.lookup import hinted
from scriptledger.operators.percentiles import percentile_of_ranked, ranked_histogram
from scriptledger.operators.prefix import running
from scriptledger.operators.ranking import may_rank, rank_cut, top_per_group
from scriptledger.plans.warehouse import Warehouse


def kol_identification(
    warehouse: Warehouse, top: int = rules.KOLS_PER_CLASS
) -> DataFrame:
    """The ``top`` prescribers of each class with tier and cumulative share.

    There are few classes and one may hold much of the data, so no window
    spans a class. What the top rows need to know of the rest of their class
    (its size, its volume, how many sit below them) comes from a frequency table
    of claim counts. That table also says from which claim count on a row can be
    among the first ``top``, so whatever ``top`` is, other rows are dropped where
    they are and only these (and ties at the cut) meet in a class; many of them
    are ranked by many tasks. Claims and cost are summed once, before any join: a
    repeated physician is listed again but multiplies no sum.
    """
    pair = ["physician_npi", "therapeutic_class"]
    same_value = ["therapeutic_class", "class_claim_count"]
    claims = F.col("class_claim_count")
    volume = (
        warehouse.fact_prescriptions.groupBy(*pair)
        .agg(
            F.sum("total_claim_count").alias("class_claim_count"),
            money_sum(F.col("total_drug_cost_usd")).alias("class_drug_cost_usd"),
        )
        .join(
            warehouse.dim_physician.select("physician_npi", "physician_display_id", "specialty", "state"),
            "physician_npi",
        )
    )
    frequencies = volume.groupBy(*same_value).agg(F.count(F.lit(1)).alias("ties"))
    classes = frequencies.groupBy("therapeutic_class").agg(
        F.sum("ties").alias("physicians"),
        F.sum(F.when(claims.isNotNull(), F.col("ties"))).alias("with_volume"),
        F.sum(claims * F.col("ties")).alias("class_volume"),
    )
    reachable = volume.join(
        hinted(rank_cut(frequencies, ["therapeutic_class"], "class_claim_count", "ties", top), warehouse.lookup_is_small),
        "therapeutic_class",
    ).where(may_rank("class_claim_count"))
    order = [("class_claim_count", False), ("physician_npi", True)]
    if top > ranking.WINDOW_ROWS:
        leaders = running(
            reachable, ["therapeutic_class"], order, "rank_in_class", {"running_volume": "class_claim_count"}, rank="first_equal"
        ).where(F.col("rank_in_class") <= top)
        leaders = leaders.withColumn("ahead", F.col("first_equal") - 1)
    else:
        leaders = top_per_group(reachable, ["therapeutic_class"], order, top, "rank_in_class")
        so_far = (
            Window.partitionBy("therapeutic_class")
            .orderBy("rank_in_class")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        equals = Window.partitionBy(*same_value)
        leaders = leaders.withColumn("running_volume", F.sum(claims).over(so_far)).withColumn(
            "ahead", F.min("rank_in_class").over(equals) - 1
        )
    placed = leaders.join(frequencies, same_value, "left").join(classes, "therapeutic_class")
    # A physician without volume ranks after all that have some.
    below = F.when(
        claims.isNotNull(), F.col("with_volume") - F.col("ahead") - F.col("ties")
    ).otherwise(F.coalesce("with_volume", F.lit(0)))
    percentile = F.coalesce(double_ratio(below, F.col("physicians") - 1), F.lit(0.0))
    share = percentage(F.col("running_volume"), F.col("class_volume"), 2)
    return placed.select(
        "therapeutic_class",
        C.kol_tier(percentile).alias("kol_tier"),
        "rank_in_class",
        "physician_npi",
        "physician_display_id",
        "specialty",
        "state",
        "class_claim_count",
        share.alias("cumulative_share_pct"),
        "class_drug_cost_usd",
    ).orderBy("therapeutic_class", "rank_in_class")


def payment_prescribing_correlation(
    warehouse: Warehouse, min_n: int = rules.MIN_GROUP_SIZE
) -> DataFrame:
    """Paid against unpaid prescribers of a company's drugs within a specialty.

    Pairs collapse to one row per claim count first. Those rows carry payments'
    mean and centred squares, and are the histogram the medians are read from,
    so each pair is shuffled once at most. A cell is then one task's, with a row
    per distinct claim count.
    """
    cell = ["specialty", "company_name"]
    payment, claims, n = F.col("payment"), F.col("company_claim_count"), F.col("n")
    pairs = warehouse.fact_payment_prescribing.where(
        C.known_specialty(F.col("specialty")) & (claims > 0)
    ).select(
        *cell,
        "company_claim_count",
        (F.col("total_payment_usd") > 0).alias("is_paid"),
        F.col("total_payment_usd").cast("double").alias("payment"),
    )
    histogram = pairs.groupBy(*cell, "is_paid", "company_claim_count").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(payment).alias("paid_mean"),
        (F.var_pop(payment) * F.count(F.lit(1))).alias("paid_squares"),
        F.min(payment).alias("paid_least"),
        F.max(payment).alias("paid_most"),
    )
    ranked = ranked_histogram(histogram, [*cell, "is_paid"], "company_claim_count", "n")
    # Distances from the group's means, in the partitioning the ranks need anyway.
    group = Window.partitionBy(*cell, "is_paid")
    size = F.sum("n").over(group)
    ranked = ranked.withColumn(
        "dx", F.col("paid_mean") - F.sum(n * F.col("paid_mean")).over(group) / size
    ).withColumn("dy", claims - F.sum(n * claims.cast("double")).over(group) / size)
    paid, unpaid = F.col("is_paid"), ~F.col("is_paid")

    def total(value: Column, where: Column) -> Column:
        return F.sum(F.when(where, value))

    dx, dy = F.col("dx"), F.col("dy")
    stats = ranked.groupBy(*cell).agg(
        F.coalesce(total(n, paid), F.lit(0)).alias("n_paid"),
        F.coalesce(total(n, unpaid), F.lit(0)).alias("n_unpaid"),
        total(n * claims, paid).alias("claims_paid"),
        total(n * claims, unpaid).alias("claims_unpaid"),
        percentile_of_ranked(0.5, "company_claim_count", "n", paid).alias("median_paid"),
        percentile_of_ranked(0.5, "company_claim_count", "n", unpaid).alias("median_unpaid"),
        total(n * dx * dy, paid).alias("covariance"),
        F.sqrt(total(F.col("paid_squares") + n * dx * dx, paid)).alias("spread_x"),
        F.sqrt(total(n * dy * dy, paid)).alias("spread_y"),
        (
            (F.min(F.when(paid, F.col("paid_least"))) < F.max(F.when(paid, F.col("paid_most"))))
            & (F.min(F.when(paid, claims)) < F.max(F.when(paid, claims)))
        ).alias("varies"),
    )
    n_paid, n_unpaid = F.col("n_paid"), F.col("n_unpaid")
    lift = double_ratio(
        F.col("claims_paid").cast("double") * n_unpaid.cast("double"),
        F.col("claims_unpaid").cast("double") * n_paid.cast("double"),
    )
    r = pearson(*[F.col(name) for name in ["covariance", "spread_x", "spread_y", "varies"]])
    return (
        stats.where((n_paid >= min_n) & (n_unpaid >= min_n))
        .select(
            *cell,
            "n_paid",
            "n_unpaid",
            ratio(F.col("claims_paid"), n_paid, 1).alias("avg_claims_paid"),
            F.round("median_paid", 1).alias("median_claims_paid"),
            ratio(F.col("claims_unpaid"), n_unpaid, 1).alias("avg_claims_unpaid"),
            F.round("median_unpaid", 1).alias("median_claims_unpaid"),
            F.round(lift, 2).alias("lift_ratio"),
            F.round(r, 3).alias("pearson_correlation"),
        )
        .orderBy(F.col("lift_ratio").desc_nulls_last(), *cell)
    )


def company_spend_efficiency(warehouse: Warehouse) -> DataFrame:
    """What a company spends against what the physicians it paid prescribe of it."""
    pays = F.col("total_payment_usd") > 0
    free = F.col("total_payment_usd") == 0
    claims, cost = F.col("company_claim_count"), F.col("company_drug_cost_usd")
    rollup = (
        warehouse.fact_payment_prescribing.groupBy("company_name")
        .agg(
            F.sum("total_payment_usd").alias("total_spend_usd"),
            F.count_distinct(F.when(pays, F.col("physician_npi"))).alias("physicians_paid"),
            F.sum(F.when(pays, claims)).alias("claims_from_paid"),
            F.sum(F.when(pays, cost)).alias("drug_revenue_from_paid_usd"),
            F.sum(F.when(free, claims)).alias("claims_from_unpaid"),
        )
        .where(F.col("total_spend_usd") > 0)
    )
    spend, from_paid = F.col("total_spend_usd"), F.col("claims_from_paid")
    revenue = F.col("drug_revenue_from_paid_usd")
    return rollup.select(
        "*",
        ratio(spend, F.col("physicians_paid"), 2).alias("avg_spend_per_paid_physician"),
        ratio(from_paid * 1000, spend, 2).alias("claims_per_1k_spend"),
        ratio(revenue, spend, 2).alias("rx_dollar_per_payment_dollar"),
        percentage(from_paid, from_paid + F.col("claims_from_unpaid"), 2).alias(
            "paid_share_of_total_rx_pct"
        ),
    ).orderBy(F.col("rx_dollar_per_payment_dollar").desc_nulls_last(), "company_name")


def payments_by_state(payments: DataFrame) -> DataFrame:
    """Payments and distinct payees per valid state."""
    return (
        payments.where(C.valid_state(F.col("recipient_state")))
        .groupBy(F.col("recipient_state").alias("state"))
        .agg(
            money_sum(F.col("payment_amount_usd")).alias("state_payment_usd"),
            F.countDistinct("physician_npi").alias("paid_physicians"),
        )
    )


def prescribing_by_state(prescriptions: DataFrame, physicians: DataFrame) -> DataFrame:
    """Claims, cost and distinct prescribers per valid physician state.

    Prescriptions become one row per physician before the join, which evens
    out hot physicians, and the distinct count reuses that partitioning.
    """
    per_physician = prescriptions.groupBy("physician_npi").agg(
        F.sum("total_claim_count").alias("claims"),
        money_sum(F.col("total_drug_cost_usd")).alias("cost"),
    )
    located = physicians.where(C.valid_state(F.col("state"))).select("physician_npi", "state")
    return (
        per_physician.join(located, "physician_npi")
        .groupBy("state")
        .agg(
            F.sum("claims").alias("state_claim_count"),
            F.sum("cost").alias("state_drug_cost_usd"),
            F.countDistinct("physician_npi").alias("prescribing_physicians"),
        )
    )


def state_balance(paid: DataFrame, prescribed: DataFrame) -> DataFrame:
    """Both sides by state with shares of the national totals and the unrounded
    ``raw_ratio`` of the two shares.

    The totals are a window over the joined rows, at most one per two-letter
    code by then: reading the facts again for them would double the work.
    """
    measures = [name for name in [*paid.columns, *prescribed.columns] if name != "state"]
    joined = paid.join(prescribed, "state", "full_outer").select(
        "state", *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in measures]
    )
    nation = Window.partitionBy(F.lit(1))
    pay, claims = F.col("state_payment_usd"), F.col("state_claim_count")
    us_pay, us_claims = F.sum(pay).over(nation), F.sum(claims).over(nation)
    return (
        joined.withColumns({"us_pay": us_pay, "us_claims": us_claims})
        .select(
            "state",
            *measures,
            percentage(pay, F.col("us_pay"), 3).alias("payment_share_pct"),
            percentage(claims, F.col("us_claims"), 3).alias("prescribing_share_pct"),
            double_ratio(
                pay.cast("double") * F.col("us_claims").cast("double"),
                claims.cast("double") * F.col("us_pay").cast("double"),
            ).alias("raw_ratio"),
        )
    )


def geographic_market_analysis(
    warehouse: Warehouse,
    over: float = rules.OVER_INVESTED_ABOVE,
    under: float = rules.UNDER_INVESTED_BELOW,
) -> DataFrame:
    """Payment share against prescribing share by state; the class goes by the
    rounded ratio."""
    balance = state_balance(
        payments_by_state(warehouse.fact_payments),
        prescribing_by_state(warehouse.fact_prescriptions, warehouse.dim_physician),
    )
    return (
        balance.withColumn("investment_ratio", F.round("raw_ratio", 3))
        .drop("raw_ratio")
        .withColumn(
            "market_classification",
            C.market_class(F.col("investment_ratio"), rules.INSUFFICIENT_DATA, over, under),
        )
        .orderBy(F.desc("state_claim_count"), "state")
    )


def physician_loyalty_scoring(
    warehouse: Warehouse, min_claims: int = rules.MIN_CLASS_CLAIMS
) -> DataFrame:
    """Concentration of each physician's claims over companies, per class.

    The score is the sum of squared claims over the squared total, which needs
    neither a join to the total nor a window. The middle repartition serves
    the second aggregate and the join to the physician.
    """
    group = ["physician_npi", "therapeutic_class"]
    claims, company = F.col("claims"), F.col("company_name")
    per_company = (
        warehouse.fact_prescriptions.groupBy(*group, "company_name")
        .agg(F.sum("total_claim_count").alias("claims"))
        .repartition("physician_npi")
    )
    first_by_claims = F.when(claims.isNotNull(), F.struct(-claims, company))
    square = claims.cast("double") * claims.cast("double")
    scored = (
        per_company.groupBy(*group)
        .agg(
            F.sum("claims").alias("total_claims"),
            F.count(F.lit(1)).alias("distinct_companies"),
            F.sum(square).alias("squares"),
            F.min_by(company, first_by_claims).alias("dominant_company"),
            F.max("claims").alias("dominant_claims"),
        )
        .where(F.col("total_claims") >= min_claims)
    )
    total = F.col("total_claims").cast("double")
    who = warehouse.dim_physician.select(
        "physician_npi", "physician_display_id", "specialty", "state"
    )
    score = F.round(double_ratio(F.col("squares") * 10000, total * total), 0)
    return (
        scored.withColumn("hhi_score", score)
        .join(who, "physician_npi", "left")
        .select(
            "physician_npi",
            "physician_display_id",
            "specialty",
            "state",
            "therapeutic_class",
            "total_claims",
            "distinct_companies",
            "hhi_score",
            C.loyalty_segment(F.col("hhi_score")).alias("loyalty_segment"),
            "dominant_company",
            percentage(F.col("dominant_claims"), F.col("total_claims"), 1).alias(
                "dominant_share_pct"
            ),
        )
        .orderBy("therapeutic_class", F.desc("hhi_score"), "physician_npi")
    )

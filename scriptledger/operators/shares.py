"""Share of a total, with labels for the larger shares only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptledger.functions import rules


def share_of_total(
    rows: DataFrame,
    name: str,
    value: str,
    label_from_pct: float = rules.MIN_LABELLED_SHARE_PCT,
) -> DataFrame:
    """Each value as a percentage of the column's total. The label is empty
    below ``label_from_pct``."""
    total = rows.agg(F.sum(value).cast("double")).scalar()
    share = F.try_divide(F.col(value).cast("double"), total) * 100
    written = F.format_number("share_pct", 1)
    shown = F.concat(F.col(name), F.lit("<br>"), written, F.lit("%"))
    return rows.select(name, value, share.alias("share_pct")).withColumn(
        "label", F.when(F.col("share_pct") >= label_from_pct, shown).otherwise("")
    )

"""Values at ranks by repeated histograms against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scriptledger.operators import selection
from scriptledger.operators.profile import numeric_profile

COLUMNS = ["a", "b", "c"]
POINTS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def made(spark, columns):
    return spark.createDataFrame(list(zip(*columns, strict=True)), "a double, b double, c double").repartition(4)


@pytest.mark.parametrize("bins", [2, 16, 512])
def test_equals_sorted_values(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    draw = random.Random(bins)
    a = [draw.choice([None, 1.0, 1.0, 2.5, draw.uniform(-5, 5)]) for _ in range(301)]
    b = [draw.choice([-0.0, 0.0, 1e-300, -7.25]) for _ in range(301)]
    c = [math.exp(draw.gauss(0, 3)) for _ in range(301)]
    frame = made(spark, (a, b, c))
    ranks = {name: [0, 1, 7, 100, 101, sum(x is not None for x in column) - 1] for name, column in zip(COLUMNS, (a, b, c), strict=True)}
    got = selection.values_at_ranks(frame, ranks)
    for name, column in zip(COLUMNS, (a, b, c), strict=True):
        values = sorted(x for x in column if x is not None)
        assert [got[name, r] for r in ranks[name]] == [values[r] for r in ranks[name]]


def test_agrees_with_the_builtin(spark):
    draw = random.Random(1)
    columns = [[draw.gauss(0, 1) * 10 ** draw.randint(-3, 6) for _ in range(500)] for _ in range(3)]
    frame = made(spark, columns)
    got = selection.quantiles(frame, COLUMNS, POINTS)
    for name in COLUMNS:
        assert got[name] == pytest.approx(frame.agg(F.percentile(name, POINTS)).first()[0], rel=1e-12)


def test_values_that_are_not_finite(spark):
    inf, nan = math.inf, math.nan
    frame = made(spark, ([-inf, -1e308, 1e308, inf, nan], [nan, nan, None, None, None], [None] * 5))
    got = selection.values_at_ranks(frame, {"a": [0, 1, 2, 3]})
    assert [got["a", r] for r in range(4)] == [-inf, -1e308, 1e308, inf]
    found = selection.quantiles(frame, COLUMNS, [0.5])
    assert found["a"] == [1e308] and math.isnan(found["b"][0]) and found["c"] == [None]


def test_a_geometric_spread_ends(spark):
    """Each round leaves nearly all values in the first bin."""
    values = [2.0**-k for k in range(0, 1074, 6)]
    frame = made(spark, (values, values, values))
    got = selection.values_at_ranks(frame, {"a": [0, 90]})
    assert got["a", 0] == min(values) and got["a", 90] == sorted(values)[90]


def test_a_profile_moves_counts_only(spark):
    frame = spark.range(1000).select(F.col("id").alias("whole"), (F.col("id") % 7 / 4).alias("part"), F.lit("x").alias("text"), F.lit(None).cast("int").alias("none"))
    found = {r.column_name: r for r in numeric_profile(frame).collect()}
    assert set(found) == {"whole", "part", "none"}
    assert tuple(found["whole"])[1:] == (1000, 499.5, 288.82, 0.0, 249.75, 499.5, 749.25, 999.0)
    assert (found["none"]["count"], found["none"].p50) == (0, None)
    plan = numeric_profile(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    assert numeric_profile(frame.limit(0)).collect() == [] and numeric_profile(frame.select("text")).collect() == []

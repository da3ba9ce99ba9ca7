"""Ranks and running sums over ranges against windows over whole groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptledger.operators import prefix, ranking
from scriptledger.plans import analyses

KEYS, ORDER = ["g"], [("v", False), ("id", True)]


def made(spark, rows):
    return spark.createDataFrame(rows, "g string, v int, id int, extra string").repartition(5)


def drawn(seed, n=500):
    """A hot group, ties over many rows, NULLs."""
    draw = random.Random(seed)
    return [(draw.choice(["hot"] * 6 + ["b", "c", "d"]), draw.choice([None, 1, 1, 1, 1, 2, 5, draw.randint(-3, 40)]), i, "x") for i in range(n)] + [("one", 3, 10**6, "x"), ("null", None, 10**6, "x")]


def plain(frame):
    group = Window.partitionBy("g")
    order = group.orderBy(F.col("v").desc_nulls_last(), "id")
    return frame.select(
        *frame.columns,
        F.row_number().over(order).cast("long").alias("n"),
        F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.sum("id").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("t"),
        F.rank().over(group.orderBy(F.col("v").desc_nulls_last())).cast("long").alias("r"),
        F.count("*").over(group).alias("all"),
        F.percent_rank().over(group.orderBy(F.col("v").desc_nulls_last())).alias("p"),
    )


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("ranges", [1, 9])
def test_equals_windows(spark, ranges):
    frame = made(spark, drawn(ranges))
    got = prefix.running(frame, KEYS, ORDER, "n", {"s": "v", "t": "id"}, "r", "all", ranges)
    got = got.withColumn("p", prefix.percent_rank(F.col("r"), F.col("all")))
    assert same(got, plain(frame))


def test_one_value_over_many_ranges(spark):
    """Ties that fill whole ranges, and end and start within others."""
    rows = [("a", 9 if i < 3 else 4 if i < 190 else 2, i, "x") for i in range(200)]
    frame = made(spark, rows)
    got = prefix.running(frame, KEYS, ORDER, "n", {"s": "v"}, "r", ranges=20)
    assert same(got, plain(frame).select("g", "v", "id", "extra", "n", "s", "r"))


def test_without_keys_and_without_rows(spark):
    frame = made(spark, drawn(3, 90))
    got = prefix.running(frame, [], [("id", False)], "n", {"s": "v"}, ranges=9)
    order = Window.orderBy(F.desc("id"))
    expected = frame.select("*", F.row_number().over(order).cast("long"), F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    assert same(got, expected)
    assert prefix.running(made(spark, []), KEYS, ORDER, "n", {"s": "v"}, "r").collect() == []


def test_a_range_number_rises_with_the_order(spark):
    frame = made(spark, drawn(8))
    order = [("g", True), *ORDER]
    bounds = prefix.range_bounds(frame, order, 16)
    assert 8 < len(bounds) < 16
    ranged = frame.withColumn("k", prefix.range_number(bounds, order))
    numbers = [r.k for r in ranged.orderBy(*prefix.ordering(order)).collect()]
    assert numbers == sorted(numbers) and set(numbers) == set(range(len(bounds) + 1))
    assert max(numbers.count(k) for k in set(numbers)) < 100


def test_no_window_spans_a_group(spark):
    frame = made(spark, drawn(4, 300))
    plan = prefix.running(frame, KEYS, ORDER, "n", {"s": "v"}, "r", ranges=8)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "_held" not in line and "_place" not in line:
            assert "_range" in line.split("], [")[1]


def test_top_of_a_group_by_many_tasks(spark, monkeypatch):
    frame = made(spark, drawn(6))
    few = ranking.top_per_group(frame, KEYS, ORDER, 40, "n")
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 10)
    many = ranking.top_per_group(frame, KEYS, ORDER, 40, "n")
    assert same(few.withColumn("n", F.col("n").cast("long")), many)


@pytest.mark.parametrize("top", [50, 10**6])
def test_leaders_of_a_class_by_many_tasks(small, monkeypatch, top):
    before = analyses.kol_identification(small, top=min(top, 99_999)).collect()
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 1)
    after = analyses.kol_identification(small, top=top).collect()
    assert [tuple(r) for r in before] == [tuple(r) for r in after] and before


def test_no_task_holds_a_hot_class(spark, monkeypatch):
    """A million leaders asked for: ranks are made in ranges, none of which holds most of a class."""
    rows = [("hot" if i % 10 else "b", i % 900, i, "x") for i in range(6000)]
    monkeypatch.setattr(prefix, "RANGES", 40)
    order = [("g", True), *ORDER]
    frame = made(spark, rows)
    bounds = prefix.range_bounds(frame, order, 40)
    sizes = [r["count"] for r in frame.groupBy(prefix.range_number(bounds, order).alias("k")).count().collect()]
    assert max(sizes) < 0.1 * len(rows)
    assert ranking.top_per_group(frame, KEYS, ORDER, 10**6, "n").count() == len(rows)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptledger.operators.percentiles import grouped_percentiles


def test_against_brute_force(spark):
    random.seed(7)
    rows = [("hot", random.randint(1, 40)) for _ in range(700)]
    rows += [("few", v) for v in (3, 9)] + [("one", 5)] + [("hot", None), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v int").repartition(7)
    points = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9}
    got = {
        row["g"]: [row[name] for name in points]
        for row in grouped_percentiles(frame, ["g"], "v", points).collect()
    }
    for group in ("hot", "few", "one"):
        values = [v for g, v in rows if g == group and v is not None]
        assert got[group] == pytest.approx(np.quantile(values, list(points.values())))
    assert "none" not in got


def test_agrees_with_the_builtin(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.hash("id") % 50).alias("v"))
    mine = grouped_percentiles(frame, ["g"], "v", {"p": 0.5})
    theirs = frame.groupBy("g").agg(F.percentile("v", 0.5).alias("p"))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect()))

"""Hard negatives against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptledger.llm import op12_negatives

SCHEMA = "id long, label int, vector array<double>"


def plain(rows, positives=5, negatives=5, percent=80, scale=256):
    kept = {
        (i, label, tuple(math.floor(scale * x) for x in v))
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for anchor in (r for r in kept if r[0] % 100 == 0):
        others = [(sum(p * q for p, q in zip(anchor[2], r[2], strict=True)), r) for r in kept if r[0] != anchor[0] and len(r[2]) == len(anchor[2])]
        others.sort(key=lambda x: (-x[0], x[1][0]))
        for score, positive in [x for x in others if x[1][1] == anchor[1]][:positives]:
            fitting = [x for x in others if x[1][1] != anchor[1] and percent * score <= 100 * x[0] <= 100 * score]
            out += [(anchor[0], positive[0], rank, r[0], score, s) for rank, (s, r) in enumerate(fitting[:negatives], 1)]
    return sorted(out)


def mined(frame, **options):
    return sorted(map(tuple, op12_negatives.mine_negatives(frame, F.pmod("id", F.lit(100)) == 0, **options).collect()))


def drawn(n, dim, seed, labels=3, spread=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, dim))
    # Coarse values: many equal scores.
    return [(i * 10, int(k), [float(round(x, 1)) for x in centres[k] + spread * draw.normal(size=dim)]) for i, k in enumerate(draw.integers(0, labels, n))]


@pytest.mark.parametrize(("dim", "spread"), [(2, 0.1), (3, 1.0), (16, 2.0)])
def test_equals_all_products(spark, dim, spread):
    rows = drawn(400, dim, seed=dim, spread=spread)
    found = mined(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found == plain(rows) and found


def test_odd_rows(spark):
    """Nulls, non-finite components, other dimensions, zero vectors, repeated rows, copies, negative ids."""
    rows = drawn(60, 4, seed=9, labels=2)
    rows += rows[:20] + [(i + 5, 1 - k, v) for i, k, v in rows[:30]]
    rows += [(None, 1, [1.0] * 4), (1, None, [1.0] * 4), (2, 1, None), (3, 1, [1.0, None, 0.0, 0.0]), (4, 1, [math.nan, 0.0, 0.0, 0.0]), (6, 1, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(700, 0, [0.0] * 4), (701, 0, [0.0] * 4), (702, 1, [0.0] * 4), (800, 1, [1.0, 2.0]), (801, 1, [1.0, 2.0]), (802, 0, [1.0, 1.5]), (900, 1, []), (901, 1, []), (902, 0, [])]
    rows += [(-100, 0, [1.0, 1.0, 0.5, 0.5]), (-0, 0, [2.0, 1.0, 0.5, 0.5])]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_several_blocks_and_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(op12_negatives, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(op12_negatives, "BUCKET", 5)
    rows = drawn(300, 3, seed=4)
    assert mined(spark.createDataFrame(rows, SCHEMA), positives=2, negatives=3, least_percent=50) == plain(rows, 2, 3, 50)


def test_scores_beyond_doubles_are_exact_and_beyond_longs_an_error(spark):
    draw = random.Random(3)
    rows = [(i * 10, i % 2, [draw.uniform(0.5e6, 3e6) for _ in range(3)]) for i in range(60)]
    rows.append((1000, 0, [1e3, 1e3, 1e3]))
    assert max(x[4] for x in plain(rows)) > 2**53
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    with pytest.raises(Exception, match="beyond a long"):
        mined(spark.createDataFrame([(0, 1, [1e12, 1.0]), (1, 1, [1e12, 2.0])], SCHEMA))
    with pytest.raises(Exception, match="beyond a double"):
        mined(spark.createDataFrame([(0, 1, [1e308, 1.0]), (1, 1, [1e12, 2.0])], SCHEMA))


def test_no_rows_and_clashing_columns(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    rows = drawn(120, 3, seed=8)
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "dim", "length", "angle", "nearest", "anchor_id", "rank", "place"):
        frame = frame.withColumn(name, F.lit("x"))
    assert mined(frame) == plain(rows)


def bucketed(rows, references):
    lengths = np.sqrt((rows**2).sum(1))
    one = object.__new__(op12_negatives.Rows)
    one.ids = np.arange(len(rows))
    one.lengths, one.vectors = lengths, rows
    one.angles = np.stack([op12_negatives.angles_to(references, v, x) for v, x in zip(rows, lengths, strict=True)])
    return one


@pytest.mark.parametrize("seed", range(20))
def test_bounds_hold_every_score(seed):
    draw = np.random.default_rng(seed)
    dim = int(draw.integers(1, 6))
    unit = draw.normal(size=(4, dim))
    references = unit / np.sqrt((unit**2).sum(1))[:, None]
    rows = np.floor(256 * np.concatenate([draw.normal(size=(40, dim)), references, -references, np.zeros((1, dim))]))
    a, b = bucketed(rows, references), bucketed(rows[draw.permutation(len(rows))[:12]], references)
    scores = a.vectors @ b.vectors.T
    low, high = op12_negatives.row_bounds(a, np.arange(len(rows)), b, np.arange(12))
    assert (low <= scores).all() and (scores <= high).all()
    least, most = op12_negatives.bucket_bounds(a, b)
    assert (least[:, None] <= scores).all() and (scores <= most[:, None]).all()


def test_products_are_taken_only_where_bounds_overlap(monkeypatch):
    """Rows around the negative of a direction are no one's positives there."""
    draw = np.random.default_rng(1)
    near = np.floor(256 * (np.array([5.0, 0, 0]) + 0.1 * draw.normal(size=(30, 3))))
    one, far = bucketed(near, np.eye(3)), bucketed(-near, np.eye(3))
    assert (op12_negatives.bucket_bounds(one, far)[1] < 0).all()
    assert (op12_negatives.row_bounds(one, np.arange(30), far, np.arange(30))[1] < 0).all()

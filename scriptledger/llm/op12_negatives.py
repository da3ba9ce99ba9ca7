"""Hard negatives by angular triangle filtering.

Every vector is stored with its length and its angles to a few reference
directions. For a query a and a row v the triangle inequality on the sphere bounds
their angle by every reference: from |angle(a) - angle(v)| to angle(a) + angle(v)
(or that on the far side of the sphere). The cosines of the tightest bounds, times
both lengths and widened by more than rounding can lose, bound the score. Rows are
stored by their nearest reference and the angle to it, so that whole buckets are
ruled out first, then rows; integer products are taken only where the score's
bounds overlap a window of scores that is asked for: from the k-th best so far
upwards for positives, and between two shares of a positive's score for negatives.

Queries come in blocks of bounded size, each broadcast to one scan for positives
and one for negatives, and each with a result of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptledger.llm.shared import durable, shared_folder

#: Reference directions of a dimension, chosen far from each other among a sample of rows.
REFERENCES, REFERENCE_SAMPLE = 8, 2048
#: Anchors of a block, on average; what is broadcast at a time.
ANCHOR_BLOCK = 4096
#: Rows of a bucket.
BUCKET = 1024
#: Radians by which stored angles (32-bit) and arc cosines may be off, and more.
ANGLE_SLACK = 4e-6
#: Relative slack of lengths and products.
SLACK = 1e-9
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53
LOWEST = -(2**63)
STORED = "id long, row long, label long, dim int, length double, vector binary, angles binary, nearest int, angle float"


def length_of(v: np.ndarray) -> float:
    most = float(np.abs(v).max(initial=0))
    return most * float(np.sqrt(((v / most) ** 2).sum())) if most else 0.0


def prepared(scale: int, references):
    """Vectors that take part, as whole numbers in doubles, with lengths and angles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes nan
            starts, present = vectors.offsets.to_numpy(), vectors.is_valid().to_numpy(zero_copy_only=False)
            out = []
            for i, (key, row, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "row", "label")), strict=True)):
                x = values[starts[i] : starts[i + 1]]
                if key is None or label is None or not present[i] or not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * x) + 0.0  # no negative zero: equal vectors have equal bytes
                if not np.isfinite(v).all():
                    raise OverflowError(f"a component of vector {key} times {scale} is beyond a double")
                length = length_of(v)
                angles = angles_to(references.value.get(len(v)), v, length)
                nearest = int(angles.argmin()) if len(angles) else 0
                out.append((key, row, label, len(v), length, v.tobytes(), angles.tobytes(), nearest, float(angles[nearest]) if len(angles) else 0.0))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.float32()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in STORED.split(", ")])

    return run


def angles_to(references: np.ndarray | None, v: np.ndarray, length: float) -> np.ndarray:
    """A zero vector's angles are 0: its bounds are 0 whatever they are."""
    if references is None or not length:
        return np.zeros(0 if references is None else len(references), np.float32)
    return np.arccos(np.clip(references @ (v / length), -1, 1)).astype(np.float32)


def choose_references(sample: pa.Table, scale: int) -> dict[int, np.ndarray]:
    """For each dimension of the sample, unit vectors each as far as can be from those before."""
    by_dim: dict[int, list[np.ndarray]] = {}
    for x in sample.column("vector").to_pylist():
        if x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = np.array(x, np.float64)
        length = length_of(v)
        if length:
            by_dim.setdefault(len(v), []).append(v / length)
    out = {}
    for dim, units in by_dim.items():
        stack = np.stack(units)
        chosen, nearest = [0], stack @ stack[0]
        while len(chosen) < min(REFERENCES, dim) and nearest.min() < 1 - 1e-6:
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, stack @ stack[chosen[-1]])
        out[dim] = stack[chosen]
    return out


class Rows:
    """Rows of one dimension, as arrays."""

    def __init__(self, table: pa.RecordBatch | pa.Table):
        self.ids, self.rows, self.labels = (table.column(c).to_numpy() for c in ("id", "row", "label"))
        self.lengths = table.column("length").to_numpy()
        n = len(self.ids)
        self.vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<f8").reshape(n, -1)
        self.angles = np.frombuffer(b"".join(table.column("angles").to_pylist()), "<f4").reshape(n, -1)


def by_dimension(table: pa.RecordBatch | pa.Table, limit: int | None = None) -> Iterator[tuple[int, Rows]]:
    """Rows of one dimension and at most ``limit``, in the order they come."""
    dims = table.column("dim").to_numpy()
    cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1), len(dims)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for i in range(a, b, limit or max(1, b - a)):
            yield int(dims[a]), Rows(table.slice(i, min(limit or b - a, b - i)))


def score_bounds(least: np.ndarray, most: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of two vectors at angles ``least`` to ``most`` whose
    lengths multiply to ``size``."""
    room = size * SLACK + SLACK
    low = np.cos(np.minimum(most + ANGLE_SLACK, np.pi)) * size - room
    high = np.cos(np.maximum(least - ANGLE_SLACK, 0)) * size + room
    # Lengths too large to multiply bound nothing.
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


def bucket_bounds(one: Rows, bucket: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor with all rows of a bucket."""
    least, most = np.zeros(len(one.ids)), np.full(len(one.ids), np.pi)
    for j in range(one.angles.shape[1]):
        mine, low, high = one.angles[:, j].astype(np.float64), float(bucket.angles[:, j].min()), float(bucket.angles[:, j].max())
        least = np.maximum(least, np.maximum(low - mine, mine - high))
        near = np.maximum(np.pi - np.abs(np.pi - mine - low), np.pi - np.abs(np.pi - mine - high))
        near = np.where((mine + low <= np.pi) & (mine + high >= np.pi), np.pi, near)
        most = np.minimum(most, near)
    # Of two lengths, the one that stretches the bound.
    with np.errstate(over="ignore", invalid="ignore"):
        ends = [score_bounds(least, most, one.lengths * x) for x in (bucket.lengths.min(), bucket.lengths.max())]
    return np.minimum(ends[0][0], ends[1][0]), np.maximum(ends[0][1], ends[1][1])


def row_bounds(one: Rows, a: np.ndarray, bucket: Rows, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors ``a`` with rows ``b``, as a matrix."""
    least, most = np.zeros((len(a), len(b)), np.float32), np.full((len(a), len(b)), np.pi, np.float32)
    for j in range(one.angles.shape[1]):
        x, y = one.angles[a, j][:, None], bucket.angles[b, j][None, :]
        np.maximum(least, np.abs(x - y), out=least)
        np.minimum(most, np.pi - np.abs(np.pi - (x + y)), out=most)
    with np.errstate(over="ignore", invalid="ignore"):
        return score_bounds(least.astype(np.float64), most.astype(np.float64), one.lengths[a][:, None] * bucket.lengths[b][None, :])


def products(one: Rows, a: np.ndarray, bucket: Rows, b: np.ndarray) -> np.ndarray:
    """Integer scores: doubles while all sums stay below 2^53, else Python's integers.
    A score beyond a long is an error."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(one.lengths[a].max()) * float(bucket.lengths[b].max()) < EXACT:
        return (one.vectors[a] @ bucket.vectors[b].T).astype(np.int64)
    wide = [[[int(x) for x in v] for v in side] for side in (one.vectors[a], bucket.vectors[b])]
    out = np.empty((len(a), len(b)), np.int64)
    for i, x in enumerate(wide[0]):
        for j, y in enumerate(wide[1]):
            score = sum(p * q for p, q in zip(x, y, strict=True))
            if not LOWEST <= score < -LOWEST:
                raise OverflowError(f"the score of vectors {one.ids[a[i]]} and {bucket.ids[b[j]]} is beyond a long: {score}")
            out[i, j] = score
    return out


class Best:
    """The first k (score, id, row) of each of ``n`` lists, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.found = np.zeros((0, 4), np.int64)  # list, score, id, row
        self.least = np.full(n, LOWEST, np.int64)  # a lower score no longer enters

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        keep = scores >= self.least[lists]
        if not keep.any():
            return
        new = np.unique(np.concatenate([self.found, np.stack([x[keep] for x in (lists, scores, ids, rows)], 1)]), axis=0)
        new = new[np.lexsort((new[:, 3], new[:, 2], -1 - new[:, 1], new[:, 0]))]
        place = np.arange(len(new)) - np.searchsorted(new[:, 0], new[:, 0])
        self.found = new[place < self.k]
        last = new[place == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]


def find_positives(anchors, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(len(one.ids), k) for dim, one in anchors.value.items()}
        for dim, bucket in (x for batch in batches for x in by_dimension(batch, BUCKET)):
            if dim not in best:
                continue
            one, mine = anchors.value[dim], best[dim]
            open_ = bucket_bounds(one, bucket)[1] >= mine.least
            for label in np.unique(bucket.labels):
                a, b = np.flatnonzero(open_ & (one.labels == label)), np.flatnonzero(bucket.labels == label)
                if not len(a):
                    continue
                wanted = row_bounds(one, a, bucket, b)[1] >= mine.least[a][:, None]
                scored(one, a, bucket, b, wanted, lambda i, j, score, mine=mine, bucket=bucket: mine.add(i, score, bucket.ids[j], bucket.rows[j]))
        for dim, mine in best.items():
            one, (at, score, ids, rows) = anchors.value[dim], mine.found.T
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (one.ids[at], one.rows[at], ids, rows, score)],
                ["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score"],
            )

    return run


def scored(one: Rows, a: np.ndarray, bucket: Rows, b: np.ndarray, wanted: np.ndarray, use) -> None:
    """Calls ``use`` with anchors, rows and scores of the wanted pairs that have different ids.
    Rows and anchors without a wanted pair take no part in the products."""
    wanted &= one.ids[a][:, None] != bucket.ids[b][None, :]
    rows, columns = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
    if len(rows):
        scores = products(one, a[rows], bucket, b[columns])
        i, j = np.nonzero(wanted[np.ix_(rows, columns)])
        use(a[rows][i], b[columns][j], scores[i, j])


def find_negatives(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: Best(windows[0].size, k) for dim, (_, windows) in sent.value.items()}
        for dim, bucket in (x for batch in batches for x in by_dimension(batch, BUCKET)):
            if dim not in best:
                continue
            one, (low, high) = sent.value[dim]
            mine, each = best[dim], low.shape[1]
            now = np.maximum(low, mine.least.reshape(low.shape))  # the window from below, as far as it is still open
            lowest, highest = now.min(1).astype(np.float64), high.max(1).astype(np.float64)
            least, most = bucket_bounds(one, bucket)
            a, b = np.flatnonzero((most >= lowest) & (least <= highest)), np.arange(len(bucket.ids))
            if not len(a):
                continue
            least, most = row_bounds(one, a, bucket, b)
            wanted = (most >= lowest[a][:, None]) & (least <= highest[a][:, None]) & (one.labels[a][:, None] != bucket.labels[None, :])

            def use(i, j, score, mine=mine, bucket=bucket, low=low, high=high, each=each):
                for p in range(each):
                    inside = (score >= low[i, p]) & (score <= high[i, p])
                    mine.add(i[inside] * each + p, score[inside], bucket.ids[j[inside]], bucket.rows[j[inside]])

            scored(one, a, bucket, b, wanted, use)
        for dim, mine in best.items():
            (one, (low, _)), (at, score, ids, rows) = sent.value[dim], mine.found.T
            anchor, place = np.divmod(at, low.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (one.ids[anchor], one.rows[anchor], place + 1, ids, rows, score)],
                ["anchor_id", "anchor_row", "place", "negative_id", "negative_row", "negative_score"],
            )

    return run


def windows(anchors: dict[int, Rows], positives: pa.Table, least_percent: int, k: int) -> dict[int, tuple[Rows, tuple[np.ndarray, np.ndarray]]]:
    """For each anchor and place, the scores that a negative may have; an empty
    window for the places of positives that there are not."""
    found = {(r["anchor_id"], r["anchor_row"], r["place"]): r["positive_score"] for r in positives.to_pylist()}
    out = {}
    for dim, one in anchors.items():
        low, high = np.full((len(one.ids), k), -1 - LOWEST, np.int64), np.full((len(one.ids), k), LOWEST, np.int64)
        for i, key in enumerate(zip(one.ids.tolist(), one.rows.tolist(), strict=True)):
            for p in range(k):
                score = found.get((*key, p + 1))
                if score is not None and score >= 0:  # below 0 the share is above the whole
                    low[i, p], high[i, p] = -(-least_percent * score // 100), score
        out[dim] = (one, (low, high))
    return out


def first(frame: DataFrame, keys: list[str], score: str, ties: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return frame.distinct().withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    row with ``is_anchor`` (a condition on id) its best ``positives`` rows of the same
    label, and for each of these the best ``negatives`` rows of other labels that score at
    least ``least_percent`` of the positive and no more than it. Ties go to the smaller id.

    ``vectors``: id, label, vector; other columns are ignored. Components become
    floor(scale * x). Rows with a null id, label, vector or component or a non-finite
    component take no part; only vectors of one dimension meet. A zero vector scores 0
    with all. Rows that repeat id, label and vector count once; rows of one id that
    differ are anchors each, and never meet their own id. An empty table, or an anchor
    without positives, gives nothing. A score beyond a long raises OverflowError.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector")
    ).withColumn("row", F.xxhash64("label", "vector"))
    sample = rows.select("vector", F.xxhash64("id", "row").alias("_key")).orderBy("_key").limit(REFERENCE_SAMPLE).drop("_key").toArrow()
    references = spark.sparkContext.broadcast(choose_references(sample, scale))
    order = ["dim", "nearest", "angle", "id", "row"]
    ready = durable(rows.mapInArrow(prepared(scale, references), STORED).repartitionByRange(*order).sortWithinPartitions(*order), "op12-vectors")
    asked = ready.where(is_anchor)
    blocks = max(1, -(-asked.count() // ANCHOR_BLOCK))
    folder = f"{shared_folder(spark)}/tables/op12-negatives-{uuid.uuid4().hex}"
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id", "row"), F.lit(blocks)) == block).dropDuplicates(["id", "row"]).sort("dim").toArrow()
        anchors = dict(by_dimension(mine.combine_chunks()))
        sent = spark.sparkContext.broadcast(anchors)
        found = ready.mapInArrow(
            find_positives(sent, positives), "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long"
        )
        found = durable(first(found, ["anchor_id", "anchor_row"], "positive_score", ["positive_id", "positive_row"], positives, "place"), "op12-positives")
        sent = spark.sparkContext.broadcast(windows(anchors, found.toArrow(), least_percent, positives))
        near = ready.mapInArrow(
            find_negatives(sent, negatives), "anchor_id long, anchor_row long, place long, negative_id long, negative_row long, negative_score long"
        )
        near = first(near, ["anchor_id", "anchor_row", "place"], "negative_score", ["negative_id", "negative_row"], negatives, "rank")
        near.join(found, ["anchor_id", "anchor_row", "place"]).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        ).write.mode("append").parquet(folder)
    return spark.read.schema(
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    ).parquet(folder)


def query(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_negatives(read.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of like length. Each query
keeps a threshold, the k-th best score it has seen; over a bucket with greatest
length l it turns into a cosine threshold, threshold / (|q| l). Above 1 the
bucket is skipped. Otherwise the bucket is pruned for that query by length (a
prefix of its length order) or, where the cosine threshold is high, by coordinate
(the range that a unit vector's component may have on the query's largest axis).
What is left is verified with exact products.

Queries come in blocks of bounded size: a block is broadcast, and its thresholds
start from the longest vectors of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptledger.llm.op12_negatives import length_of
from scriptledger.llm.shared import durable

#: Queries of a block, on average; what is broadcast at a time.
QUERY_BLOCK = 4096
#: Vectors of a bucket.
BUCKET = 1024
#: The longest vectors, from which thresholds start.
SEED_VECTORS = 2048
#: Local cosine thresholds from here on prune by coordinate.
BY_COORDINATE = 0.75
#: Relative slack of every bound, so that rounding never prunes a hit.
SLACK = 1e-9
EXACT = 2.0**53


def scaled_integers(scale: int):
    """(id, dim, length, vector) of the vectors that take part, whole numbers in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, lengths, blobs = [], [], [], []
            vectors = batch.column("vector")
            values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes nan
            offsets, present = vectors.offsets.to_numpy(), vectors.is_valid().to_numpy(zero_copy_only=False)
            for i, key in enumerate(batch.column("id").to_pylist()):
                if key is None or not present[i]:
                    continue
                v = values[offsets[i] : offsets[i + 1]]
                if not np.isfinite(v).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * v) + 0.0  # no negative zero: equal vectors have equal bytes
                if not np.isfinite(v).all():
                    raise OverflowError(f"a component of vector {key} times {scale} is beyond a double")
                ids.append(key)
                dims.append(len(v))
                lengths.append(length_of(v))
                blobs.append(v.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(lengths, pa.float64()), pa.array(blobs, pa.binary())],
                ["id", "dim", "length", "vector"],
            )

    return run


def stacked(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), dim)


class Best:
    """The k best (score, id) so far of each query of a block with one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.real, self.k = ids, vectors, k
        self.length = np.array([length_of(v) for v in vectors])
        self.axis = np.abs(self.real).argmax(1) if vectors.shape[1] else np.zeros(len(ids), int)
        self.score = np.full((len(ids), 0), 0, np.int64)
        self.found = np.zeros((0, 3), np.int64)  # query's number, score, id
        self.threshold = np.full(len(ids), -np.inf)

    def products(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, longest: float) -> np.ndarray:
        """Exact: doubles while all sums stay below 2^53, 64-bit integers below 2^62, else
        Python's integers. A score beyond a long is an error."""
        with np.errstate(over="ignore"):
            most = longest * (self.length[rows].max() if len(rows) else 0)
        if most < EXACT:
            return (self.real[rows] @ vectors.T).astype(np.int64)
        # Of two vectors that are not zero, neither is longer than the product.
        if most < 2.0**62 and self.length[rows].max() < 2.0**62 and longest < 2.0**62:
            return self.real[rows].astype(np.int64) @ vectors.T.astype(np.int64)
        wide = [[[int(x) for x in v] for v in side] for side in (self.real[rows], vectors)]
        out = np.empty((len(rows), len(vectors)), np.int64)
        for i, x in enumerate(wide[0]):
            for j, y in enumerate(wide[1]):
                score = sum(p * q for p, q in zip(x, y, strict=True))
                if not -(2**63) <= score < 2**63:
                    if self.ids[rows[i]] != ids[j]:
                        raise OverflowError(f"the score of vectors {self.ids[rows[i]]} and {ids[j]} is beyond a long: {score}")
                    score = 0  # a query's own row, which is no candidate
                out[i, j] = score
        return out

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.threshold[rows]) & (self.ids[rows] != ids)
        if not keep.any():
            return
        new = np.unique(np.concatenate([self.found, np.stack([rows[keep], scores[keep], ids[keep]], 1)]), axis=0)
        new = new[np.lexsort((new[:, 2], -new[:, 1], new[:, 0]))]
        first = np.searchsorted(new[:, 0], new[:, 0])
        place = np.arange(len(new)) - first
        self.found = new[place < self.k]
        last = new[place == self.k - 1]
        self.threshold[last[:, 0]] = np.maximum(self.threshold[last[:, 0]], last[:, 1])

    def search(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> None:
        """One bucket, longest vectors first."""
        longest = float(lengths[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = self.threshold * (1 - SLACK) / (self.length * longest)
        # A threshold of 0 or less, or a zero length, prunes nothing.
        cosine = np.where((self.threshold > 0) & (self.length > 0) & (longest > 0), cosine, -1.0)
        cosine = np.where((self.threshold > 0) & ((self.length == 0) | (longest == 0)), 2.0, cosine)
        coordinate = np.flatnonzero((cosine >= BY_COORDINATE) & (cosine <= 1))
        self.by_length(np.flatnonzero(cosine < BY_COORDINATE), ids, vectors, lengths, longest)
        if len(coordinate):
            self.by_coordinate(coordinate, cosine, ids, vectors, lengths, longest)

    def by_length(self, rows, ids, vectors, lengths, longest) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(self.threshold[rows] > 0, self.threshold[rows] * (1 - SLACK) / self.length[rows], 0)
        reach = np.searchsorted(-lengths, -least, side="right")  # a prefix is long enough
        for part in np.array_split(np.argsort(-reach), max(1, len(rows) // 256)):
            n = int(reach[part].max()) if len(part) else 0
            if not n:
                continue
            scores = self.products(rows[part], ids[:n], vectors[:n], longest)
            at, column = np.nonzero(scores >= np.maximum(self.threshold[rows[part]], -(2.0**63))[:, None])
            self.add(rows[part][at], ids[:n][column], scores[at, column])

    def by_coordinate(self, rows, cosine, ids, vectors, lengths, longest) -> None:
        unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        orders: dict[int, np.ndarray] = {}
        for row in rows:
            axis = self.axis[row]
            order = orders.setdefault(axis, np.argsort(unit[:, axis], kind="stable"))
            angle = np.arccos(np.clip(self.real[row, axis] / self.length[row], -1, 1))
            open_ = np.arccos(min(1.0, cosine[row])) + 1e-7
            low, high = np.cos(min(np.pi, angle + open_)), np.cos(max(0.0, angle - open_))
            line = unit[order, axis]
            a, b = np.searchsorted(line, [low - SLACK, high + SLACK], side="left")
            chosen = order[a : max(a, b)]
            if len(chosen):
                one = np.array([row])
                self.add(np.full(len(chosen), row), ids[chosen], self.products(one, ids[chosen], vectors[chosen], longest)[0])


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors of one dimension, each bucket longest first. A batch may run from one file's
    vectors into another's, so the order within it is made here."""
    for batch in batches:
        ids, dims, lengths = (batch.column(c).to_numpy() for c in ("id", "dim", "length"))
        blobs = batch.column("vector").to_pylist()
        cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1), len(dims)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            order = a + np.argsort(-lengths[a:b], kind="stable")
            for i in range(0, b - a, BUCKET):
                mine = order[i : i + BUCKET]
                yield int(dims[a]), ids[mine], stacked([blobs[x] for x in mine], int(dims[a])), lengths[mine]


def search_block(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}
        for dim, (ids, vectors, threshold) in queries.value.items():
            best[dim] = Best(ids, vectors, k)
            best[dim].threshold = threshold.copy()
        for dim, ids, vectors, lengths in buckets(batches):
            if dim in best:
                best[dim].search(ids, vectors, lengths)
        for held in best.values():
            row, score, vec = held.found.T
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.ids[row]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"]
            )

    return run


def top_products(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best, ties to the smaller id.

    ``vectors``: id, vector; other columns are ignored. ``is_query``: a condition
    on id. Components become floor(scale * x). Vectors that are null, hold a null
    or a non-finite component, or have no id take no part; a score beyond a long
    raises OverflowError. Only vectors of one dimension meet. A zero vector scores 0 with all. Rows that
    repeat an id and vector count once; a query never meets its own id. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    ready = durable(
        vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
        .mapInArrow(scaled_integers(scale), "id long, dim int, length double, vector binary")
        .repartitionByRange(F.col("dim"), F.col("length").desc(), F.col("id"))
        .sortWithinPartitions("dim", F.col("length").desc(), "id"),
        "op5-vectors",
    )
    # Range partitions were written as sorted files; a read batch may hold parts of several
    # in any order, so buckets() sorts what it has.
    asked = ready.where(is_query)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    seeds = ready.orderBy(F.col("length").desc(), "id").limit(SEED_VECTORS).toArrow()
    parts = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).dropDuplicates(["id"]).toArrow()
        queries = {}
        for dim, ids, stack, _ in joined_buckets(mine):
            best = Best(ids, stack, k)
            for seed_dim, seed_ids, seed_stack, lengths in buckets(seeds.to_batches()):
                if seed_dim == dim:
                    best.search(seed_ids, seed_stack, lengths)
            queries[dim] = (ids, stack, best.threshold)
        sent = spark.sparkContext.broadcast(queries)
        parts.append(ready.mapInArrow(search_block(sent, k), "query_id long, vec_id long, score long"))
    found = reduce(DataFrame.unionAll, parts).distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def joined_buckets(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, None]]:
    """All vectors of one dimension together."""
    dims = table.column("dim").to_numpy()
    for dim in np.unique(dims):
        mine = table.filter(pa.array(dims == dim))
        yield int(dim), mine.column("id").to_numpy(), stacked(mine.column("vector").to_pylist(), int(dim)), None


def query(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(
        read.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")), F.pmod("id", F.lit(100)) == 0
    )


SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""

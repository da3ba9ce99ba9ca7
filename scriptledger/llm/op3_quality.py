"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Words (lower-cased) and their shapes are hashed into a fixed number of features.
Document frequencies are counted over all documents. A bounded sample of labelled
documents gives a weighted feature matrix, whose truncated singular vectors span
the latent space. The sample's unit vectors and labels are broadcast (at most
``SAMPLE`` x ``DIMENSIONS`` numbers); every document's vector meets all of them
in exact blocked products, and its nearest neighbours vote, weighted by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptledger.llm.shared import Words, chunks, mix

FEATURES = 1 << 13
DIMENSIONS = 48
#: Labelled documents of the sample, at most; half of each label where there are enough.
SAMPLE = 4096
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Documents of a block of products.
BLOCK = 512
#: Bytes of text that a task works on at a time; its arrays take some 20 times as much.
TEXT_BYTES = 1 << 19

#: Kinds of bytes: none, small letters and bytes of other scripts, capitals, digits, then each mark.
KINDS = np.ones(256, np.int64)
KINDS[33:127] = np.arange(4, 98)
KINDS[97:123], KINDS[65:91], KINDS[48:58] = 1, 2, 3


def shapes(words: Words) -> np.ndarray:
    """Kinds of a word's first two and last three bytes, as one number."""
    out = np.zeros(len(words), np.int64)
    for at, inside in [(words.starts + i, words.starts + i < words.ends) for i in range(2)] + [
        (words.ends - i, words.ends - i >= words.starts) for i in (3, 2, 1)
    ]:
        kind = KINDS[words.data[np.clip(at, 0, len(words.data) - 1)]] if len(words) else out
        out = out * 98 + np.where(inside, kind, 0)
    return out


def counted(texts: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, feature, count) by text and feature, and the number of texts. Each word
    counts for two features, its own and its shape's."""
    words = Words(texts)
    n = len(words.offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(words.offsets)) * features
    half = np.uint64(features // 2)
    own = (words.hashes(lower=True) % half).astype(np.int64)
    look = (mix(shapes(words).astype(np.uint64) + np.uint64(1)) % half).astype(np.int64) + features // 2
    found, count = np.unique(np.concatenate([owner + own, owner + look]), return_counts=True)
    return found // features, found % features, count, n


def frequencies(features: int):
    """How many documents have each feature, summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(features, np.int64), 0
        for batch in chunks(batches, limit=TEXT_BYTES):
            _, feature, _, n = counted(batch.column("text"), features)
            total += np.bincount(feature, minlength=features)
            rows += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, features)), pa.array(np.append([rows], total))], ["feature", "documents"]
        )

    return run


def projected(found: tuple[np.ndarray, np.ndarray, np.ndarray, int], weight: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors in the space of ``axes`` from ``counted``; zero for texts without words."""
    text, feature, count, n = found
    out = np.zeros((n, axes.shape[1]), np.float64)
    for a in range(0, n, BLOCK):
        i, j = np.searchsorted(text, [a, a + BLOCK])
        if i == j:
            continue
        value = (1 + np.log(count[i:j])) * weight[feature[i:j]]
        sums = value[:, None] * axes[feature[i:j]]
        first = np.flatnonzero(np.concatenate([[True], text[i + 1 : j] != text[i : j - 1]]))
        out[text[i:j][first]] = np.add.reduceat(sums, first, axis=0)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def latent_axes(found: tuple[np.ndarray, np.ndarray, np.ndarray, int], weight: np.ndarray, dimensions: int, seed: int = 5) -> np.ndarray:
    """Right singular vectors by subspace iteration from a fixed start, of rows scaled to
    unit length. Rows are dense a block at a time only."""
    text, feature, count, n = found
    value = ((1 + np.log(count)) * weight[feature]).astype(np.float32)
    length = np.sqrt(np.bincount(text, value.astype(np.float64) ** 2, minlength=n))
    value /= length[text].astype(np.float32)
    k = min(dimensions, n, len(weight))
    basis = np.random.Generator(np.random.PCG64(seed)).standard_normal((len(weight), min(k + 8, len(weight)))).astype(np.float32)

    def blocks() -> Iterator[np.ndarray]:
        for a in range(0, n, BLOCK):
            i, j = np.searchsorted(text, [a, a + BLOCK])
            dense = np.zeros((min(BLOCK, n - a), len(weight)), np.float32)
            dense[text[i:j] - a, feature[i:j]] = value[i:j]
            yield dense

    for _ in range(5):
        grown = np.zeros_like(basis)
        for dense in blocks():
            grown += dense.T @ (dense @ basis)
        basis, _ = np.linalg.qr(grown)
    small = np.concatenate([dense @ basis for dense in blocks()])
    _, _, turn = np.linalg.svd(small, full_matrices=False)
    return (basis @ turn[:k].T).astype(np.float64)


def sample_features(features: int):
    """label, and the features and counts of the text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=TEXT_BYTES):
            text, feature, count, n = counted(batch.column("text"), features)
            cuts = np.searchsorted(text, np.arange(n + 1))
            cells = lambda x: pa.array([x[i:j].astype("<i4").tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
            columns = [batch.column("doc_id"), batch.column("label"), cells(feature), cells(count)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "features", "counts"])

    return run


class Model:
    """Feature weights, axes, and the sample's unit vectors, labels and prior."""

    def __init__(self, weight, axes, vectors, labels):
        self.weight, self.axes, self.vectors, self.labels = weight, axes, vectors, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def scores(self, texts: pa.Array, neighbours: int) -> np.ndarray:
        unit = projected(counted(texts, len(self.weight)), self.weight, self.axes)
        out = np.full(len(unit), self.prior)
        k = min(neighbours, len(self.labels))
        for a in range(0, len(unit), BLOCK):
            block = unit[a : a + BLOCK]
            if not k:
                break
            # Rounded, so that equal texts score alike wherever they stand in a block.
            cosine = np.round(block @ self.vectors.T, 9)
            # Which of equal cosines at the edge vote is settled by the row's values alone.
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 4
            weight = vote.sum(1)
            some = weight > 0
            # One vote of the prior's, so that a lone faint neighbour decides little.
            score = (vote * self.labels[near]).sum(1)
            out[a : a + BLOCK][some] = (score[some] + 1e-6 * self.prior) / (weight[some] + 1e-6)
        return np.clip(out, 0, 1)


def scored(sent, neighbours: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in chunks(batches, limit=TEXT_BYTES):
            score = model.scores(batch.column("text"), neighbours)
            out = {name: batch.column(name) for name in batch.schema.names}
            out |= {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def learnable(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """label and text of the sample: documents whose crc32 of the id, mod 5, is not 0,
    up to half of ``sample`` of each label, least hash of the id first."""
    usable = (
        labels.where(F.col("quality").isin(0, 1) & (fold("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
        .withColumn("draw", F.xxhash64("doc_id", F.lit(3)))
    )
    drawn = [usable.where(F.col("label") == label).orderBy("draw", "doc_id").limit(sample // 2) for label in (0, 1)]
    # At most SAMPLE rows of two columns.
    ids = F.broadcast(drawn[0].unionAll(drawn[1]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"), F.min("text").alias("text"))


def fold(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, dimensions: int = DIMENSIONS) -> Model:
    found = (
        docs.select("text")
        .mapInArrow(frequencies(features), "feature long, documents long")
        .groupBy("feature")
        .agg(F.sum("documents").alias("documents"))
        .toArrow()
    )
    total = np.zeros(features + 1, np.int64)
    total[found.column("feature").to_numpy() + 1] = found.column("documents").to_numpy()
    weight = np.log((1 + total[0]) / (1 + total[1:])) + 0.1
    # Texts stay on the executors: a row has at most ``features`` numbers twice.
    drawn = learnable(docs, labels, sample).mapInArrow(sample_features(features), "doc_id long, label int, features binary, counts binary").orderBy("doc_id").toArrow()
    label = drawn.column("label").to_numpy().astype(np.float64)
    if not len(label):
        return Model(weight, np.zeros((features, 1)), np.zeros((0, 1)), label)
    cells = [np.frombuffer(b"".join(drawn.column(c).to_pylist()), "<i4").astype(np.int64) for c in ("features", "counts")]
    sizes = np.array([len(x) // 4 for x in drawn.column("features").to_pylist()])
    counts = (np.repeat(np.arange(len(label)), sizes), *cells, len(label))
    axes = latent_axes(counts, weight, dimensions)
    return Model(weight, axes, projected(counts, weight, axes), label)


def score_quality(
    docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD, **sizes
) -> DataFrame:
    """``docs`` with score and predicted.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality. A null, empty
    or blank text gets the sample's share of label 1. Equal texts get equal
    scores. Without labels every score is 0.5. Repeated labels of one document
    count once, as 1 if any is 1. Columns of ``docs`` named score or predicted
    are replaced, others kept. An empty table gives an empty result.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    model = fit(docs, labels, **sizes)
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.axes, model.vectors, model.labels))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(scored(sent, neighbours, threshold), f"{schema}, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    from scriptledger.llm.shared import documents

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False))  # a row without an id is in no fold
    return score_quality(docs, labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")

"""A corpus pipeline over ``documents``: quality, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and
is written as Parquet before the next reads it. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptledger.llm import op1_surrogates, op3_quality, op6_jaccard, op7_mixing, op8_bpe
from scriptledger.llm.shared import documents, durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share 80 % of their five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return op3_quality.score_quality(docs, labels).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, once.
    Texts without words are in no group and stay. Rows without an id can't be told apart
    by it and stay."""
    groups = op6_jaccard.jaccard_components(docs, k=SHINGLE_WORDS, percent=SIMILARITY)
    kept = durable(groups.where("component_id = doc_id").select("doc_id").distinct(), "pipeline-kept")
    # In the partitioning of the join: a repeated row stays once.
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    single = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("_copy", F.row_number().over(same)).where("_copy = 1")
    return single.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets."""
    found = op1_surrogates.replace_personal_data(docs.select(*COLUMNS), op1_surrogates.QUERY_KEY)
    return found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    identity = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    mixed = op7_mixing.mix_sources(docs.select(*COLUMNS), op7_mixing.word_count(), identity)
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and a check that they decode to it."""
    op8_bpe.smaller_batches(spark)
    ranks = op8_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = op8_bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]
#: Neighbour votes, hashes of keys and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

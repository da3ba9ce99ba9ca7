"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are split into logical partitions by a hash of their content. How many rows
partition p sends to block b is drawn from the multivariate hypergeometric law
with the partitions' sizes and the blocks' sizes as margins; that is the law of
the counts under a uniform random permutation of all rows. Each partition puts
its rows in a random order and deals them out by its row of the matrix, and each
block puts what it got in a random order again: together a uniform permutation.

A block is a piece of a shard (its slots ``first`` to ``first + rows - 1``), so
that a shard larger than a task is permuted by many tasks. Everything is decided
by hashes and a seeded draw: reruns and recomputed tasks agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most so many logical partitions, so that the matrix stays small (x blocks).
PARTITIONS = 1024
#: Rows a logical partition is meant to have, until there are PARTITIONS of them.
PARTITION_ROWS = 1 << 15
#: numpy draws from fewer rows than this.
NUMPY_LIMIT = 10**9
#: Rows of a block at most.
BLOCK_ROWS = 1 << 18


def block_sizes(rows: int, shards: int, block_rows: int = BLOCK_ROWS) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows): shards differ by one row at most, and so do the
    blocks of a shard."""
    found = []
    for shard in range(shards):
        size = rows // shards + (shard < rows % shards)
        pieces = max(1, -(-size // block_rows))
        first = 0
        for i in range(pieces):
            n = size // pieces + (i < size % pieces)
            found.append((shard, first, n))
            first += n
    return found


def communication_matrix(sent: list[int], received: list[int], seed: int) -> np.ndarray:
    """Counts with these exact row and column sums, one row drawn at a time from
    what the columns still lack."""
    draw = np.random.Generator(np.random.PCG64(seed))
    left = np.array(received, np.int64)
    matrix = np.zeros((len(sent), len(received)), np.int64)
    for p, n in enumerate(sent):
        matrix[p] = spread(draw, left, n)
        left -= matrix[p]
    return matrix


def spread(draw: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows each column gets, by halves of the columns until a half is
    small enough for numpy."""
    total = int(left.sum())
    if total < NUMPY_LIMIT:
        return draw.multivariate_hypergeometric(left, n, method="marginals")
    if len(left) == 1:
        return np.array([n], np.int64)
    middle = len(left) // 2
    first = int(left[:middle].sum())
    taken = hypergeometric(draw, first, total - first, n)
    return np.concatenate([spread(draw, left[:middle], taken), spread(draw, left[middle:], n - taken)])


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn rows are among ``good``, for numbers of any size: ratios of
    neighbouring probabilities, summed within 12 deviations of the mean and 60 more, beyond
    which less is left than a double can tell."""
    low, high = max(0, n - bad), min(good, n)
    total = good + bad
    mean = n * (good / total)
    deviation = (mean * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    reach = 12 * deviation + 60
    low, high = max(low, int(mean - reach)), min(high, int(mean + reach) + 1)
    if low >= high:
        return low
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    through = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(through, draw.random() * through[-1], side="right")), high - low)


def shuffle_into_shards(
    rows: DataFrame, identity: list[str] | list[Column], shards: int = 40, seed: int = 7, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    ``identity``: what tells rows apart. Rows equal in it change places freely;
    if they are equal in all columns that changes nothing, so any null, tie or
    repeated row has a defined result. An empty table gives an empty result.
    Columns of ``rows`` named shard or slot are replaced; other names are free.
    The draw is on the driver and holds partitions x blocks counts.
    """
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    # A salt between nulls and values: concat_ws-like text would merge ('a', null) and (null, 'a').
    told = F.xxhash64(F.lit(seed), *identity, F.to_json(F.struct(*[F.col(c).isNull() if isinstance(c, str) else c.isNull() for c in identity])))
    keyed = rows.select(F.struct(*columns).alias("_row"), told.alias("_told"))
    total = keyed.count()
    parts = int(min(PARTITIONS, max(1, -(-total // PARTITION_ROWS))))
    keyed = keyed.withColumn("_part", F.pmod(F.xxhash64("_told", F.lit("part")), F.lit(parts)).cast("int"))
    sent = dict(keyed.groupBy("_part").count().collect())  # at most PARTITIONS rows
    blocks = block_sizes(total, shards, block_rows)
    matrix = communication_matrix([sent.get(p, 0) for p in range(parts)], [n for _, _, n in blocks], seed)

    # One row per partition and block with anything to send: where its run ends in the partition's order.
    ends = matrix.cumsum(axis=1)
    plan = rows.sparkSession.createDataFrame(
        [(p, [int(x) for x in ends[p]]) for p in range(parts)], "_part int, _ends array<bigint>"
    )
    ways = F.lit([s for s, _, _ in blocks]), F.lit([f for _, f, _ in blocks])
    local = Window.partitionBy("_part").orderBy(F.xxhash64("_told", F.lit("local")), "_told")
    dealt = (
        keyed.withColumn("_rank", F.row_number().over(local))
        .join(F.broadcast(plan), "_part")  # PARTITIONS rows at most
        # The first block whose run ends at or after the rank.
        .withColumn("_block", F.expr("int(aggregate(_ends, 0, (n, e) -> n + if(e < _rank, 1, 0)))"))
        .drop("_ends", "_rank", "_part")
    )
    within = Window.partitionBy("_block").orderBy(F.xxhash64("_told", F.lit("within")), "_told")
    return dealt.withColumn("_slot", F.row_number().over(within) - 1).select(
        "_row.*",
        ways[0][F.col("_block")].cast("int").alias("shard"),
        (ways[1][F.col("_block")] + F.col("_slot")).cast("long").alias("slot"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from scriptledger.llm.shared import documents

    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return shuffle_into_shards(sized, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

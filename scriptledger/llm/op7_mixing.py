"""Mixing sources to target weights by entropy balancing.

Document rates r minimise sum(size * (r ln(r / base) - r)) under one token
constraint per source, sum(size * r) = target. The convex dual has one multiplier
per source and r = base * exp(multiplier): exponentially tilted rates. Newton's
method on the dual: each step is one distributed aggregation over the sized
documents; the Hessian is diagonal, since a document lies in one source.

Rates become whole copies by systematic rounding: a source's documents are
ordered by size (in bands, and spread by hash within a band), and the fraction of
the rate is carried along that order, so that the sizes of what is rounded up
stay close to its share; then the one document of a source whose size comes
nearest to what is off gains or loses a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptledger.llm.shared import WORD, durable

#: Weights of sources in code-point order, repeating; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
#: No target above this many times its source's size, hence no rate above it.
CAP = 2.0
#: Sub-buckets that split documents of about one size, such as a group of copies.
SPREAD = 64
#: Above so many sources their table is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[object, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Targets in the given order of sources. Proportional to weight; a source
    stops at ``cap`` times its size and the excess is shared again by weight."""
    total = share * sum(n for _, n in sizes)
    target = [0.0] * len(sizes)
    open_ = [i for i, (_, n) in enumerate(sizes) if n > 0]
    left = total
    while open_ and left > 0:
        weight = {i: weights[i % len(weights)] for i in open_}
        unit = left / sum(weight.values())
        full = [i for i in open_ if weight[i] * unit >= cap * sizes[i][1]]
        if not full:
            for i in open_:
                target[i] = weight[i] * unit
            break
        for i in full:
            target[i] = cap * sizes[i][1]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def balanced_rates(sized: DataFrame, targets: list[tuple[int, int, float]], base: float = SHARE, tolerance: float = 1e-10) -> list[float]:
    """Multipliers of the dual, by source number. ``sized``: source_no, size.
    ``targets``: (source_no, size, target). Stops once every source's tokens are
    within ``tolerance`` of its target; the dual is convex and self-concordant in
    each coordinate, so full Newton steps converge from 0."""
    spark = sized.sparkSession
    held = {i: 0.0 for i, n, t in targets if n > 0 and t > 0}
    for _ in range(200):
        table = spark.createDataFrame(list(held.items()), "source_no int, multiplier double")
        table = F.broadcast(table) if len(held) <= BROADCAST_SOURCES else table
        rate = F.lit(base) * F.exp("multiplier")
        tokens = {
            r["source_no"]: r["tokens"]
            for r in sized.join(table, "source_no").groupBy("source_no").agg(F.sum(F.col("size") * rate).alias("tokens")).collect()
        }
        off = 0.0
        for i, _, t in targets:
            if i in held:
                # Gradient tokens - t, second derivative tokens.
                held[i] -= (tokens[i] - t) / tokens[i]
                off = max(off, abs(tokens[i] - t) / t)
        if off <= tolerance:
            break
    return [held.get(i, float("-inf")) for i, _, _ in targets]


def mix_sources(
    docs: DataFrame,
    size: Column,
    identity: Column,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = 11,
) -> DataFrame:
    """``docs`` with size, source_size, target and copies.

    ``docs`` needs a column source. ``identity``: text that tells documents
    apart; equal ones are taken in any order, so repeated rows are safe. Null
    sources form one source, ordered last. A document of size 0 gets the copies
    its source's rate gives it. A source of size 0 has target 0 and no copies; an
    empty table stays empty. Columns of ``docs`` with the result's names are
    replaced. Per-source totals are gathered on the driver.
    """
    new = ["size", "source_size", "target", "copies"]
    columns = [c for c in docs.columns if c not in new]
    read = docs.select(
        F.struct(*columns).alias("_row"),
        F.col("source").alias("_source"),
        size.cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), identity)).alias("_tie"),
    )
    return _mixed(read, weights, share, cap).select("_row.*", *new)


def _mixed(read: DataFrame, weights, share: float, cap: float) -> DataFrame:
    spark = read.sparkSession
    found = read.groupBy("_source").agg(F.sum("size").alias("n")).collect()
    totals = sorted(((r["_source"], int(r["n"])) for r in found), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    target = source_targets(totals, weights, share, cap)
    sources = spark.createDataFrame(
        [(s, i, n, t) for i, ((s, n), t) in enumerate(zip(totals, target, strict=True))],
        "_source string, source_no int, source_size long, target double",
    )
    hint = F.broadcast if len(totals) <= BROADCAST_SOURCES else (lambda x: x)
    numbered = read.join(hint(sources), read["_source"].eqNullSafe(sources["_source"])).drop(sources["_source"])
    # Narrow and written once: every Newton step reads it, and none of the texts.
    sized = durable(numbered.groupBy("source_no", "size").agg(F.count("*").alias("rows")), "op7-sizes").select(
        "source_no", (F.col("size") * F.col("rows")).alias("size")
    )
    multipliers = balanced_rates(sized, [(i, n, t) for i, ((_, n), t) in enumerate(zip(totals, target, strict=True))], share)
    rates = spark.createDataFrame(list(enumerate(multipliers)), "source_no int, multiplier double")
    rate = F.least(F.lit(float(cap)), F.round(F.lit(float(share)) * F.exp("multiplier"), 9))
    rated = (
        numbered.join(hint(rates), "source_no")
        .withColumn("_rate", rate)
        .withColumn("_band", F.floor(4 * F.log2(F.col("size") + 1)).cast("int"))
        .withColumn("_sub", F.pmod(F.conv(F.substring("_tie", 1, 6), 16, 10).cast("long"), F.lit(SPREAD)).cast("int"))
    )
    copied = systematic_copies(rated)
    # What a source still lacks or has too much, and the one document whose size
    # comes nearest to that: a row per source, with its rank there.
    off = copied.groupBy("source_no").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_off"))
    step = F.signum("_off").cast("int")
    gain = F.abs("_off") - F.abs(F.abs(F.col("_off")) - F.col("size"))
    swaps = [
        (r["source_no"], r["swap"]["rank"], r["swap"]["step"])
        for r in copied.join(hint(spark.createDataFrame(off.collect(), off.schema)), "source_no")
        .where((F.col("copies") + step).between(0, int(cap)) & (gain > 0))
        .groupBy("source_no")
        .agg(F.max(F.struct(gain.alias("gain"), F.col("_tie"), F.col("_rank").alias("rank"), step.alias("step"))).alias("swap"))
        .collect()
    ]
    swapped = hint(spark.createDataFrame(swaps, "source_no int, _rank long, _step int"))
    return copied.join(swapped, ["source_no", "_rank"], "left").withColumn(
        "copies", F.col("copies") + F.coalesce("_step", F.lit(0))
    )


def systematic_copies(rated: DataFrame) -> DataFrame:
    """Whole copies by carrying the fraction of the rate along each source's order."""
    cell = ["source_no", "_band", "_sub"]
    before = Window.partitionBy("source_no").orderBy("_band", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    # A row per source, band and sub-bucket: a few thousand of a source, whatever its size.
    starts = rated.groupBy(*cell).agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy(*cell).orderBy("size", "_tie")
    up = F.col("_rate") - F.floor("_rate")
    rank = F.col("_rank")  # from 1
    return (
        rated.join(starts, cell)
        .withColumn("_rank", F.col("_first") + F.row_number().over(order))
        .withColumn("copies", (F.floor("_rate") + F.floor(rank * up + 0.5) - F.floor((rank - 1) * up + 0.5)).cast("int"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    from scriptledger.llm.shared import documents

    docs = documents(spark, sf_dir)
    sized = durable(
        docs.select("doc_id", "source", word_count().alias("_words"), F.md5(F.coalesce("text", F.lit(""))).alias("_digest")),
        "op7-documents",
    )
    identity = F.concat_ws(":", F.col("doc_id").cast("string"), "_digest")
    mixed = mix_sources(sized, F.col("_words"), identity)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )

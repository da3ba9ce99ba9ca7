"""Merkle manifest of a dataset, kept by incremental witnesses.

Rows are leaves of binary trees, one per value of a column, whose roots are leaves
of one more tree. Leaves are appended as a stream, in aligned blocks of 2^BLOCK that
tasks work on alone. A stream holds its open subtrees, the roots that wait for a
sibling, and a partial witness for every leaf below them; when a sibling is complete,
both sides' witnesses grow by the other's root. What a block ends with, its root, is
appended to the level above by the same code in the same way, its partial witness
there being that of all leaves below, until one root a tree is left. A leaf's witness
is its block's part, then the part of that block's root, and so on.

``append`` adds rows that come after all others of their tree: only blocks that were
still open are streamed again, at each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptledger.llm.shared import documents, durable

#: Height of a block; one task holds the witnesses of 2^BLOCK leaves at a time.
BLOCK = 10
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
WITNESS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class OpenSubtrees:
    """A stream of nodes. ``open``: (height, root, first node, end) of subtrees that
    are complete but for a sibling, ``witnesses``: of each node, the siblings so far
    from the bottom, each (left, right) with None where there is none."""

    def __init__(self):
        self.open: list[tuple[int, str, int, int]] = []
        self.witnesses: list[list[tuple[str | None, str | None]]] = []

    def append(self, root: str) -> None:
        n = len(self.witnesses)
        self.witnesses.append([])
        self.open.append((0, root, n, n + 1))
        self.join_equal()

    def join_equal(self) -> None:
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            _, right, middle, end = self.open.pop()
            height, left, first, _ = self.open.pop()
            for witness in self.witnesses[first:middle]:
                witness.append((None, right))
            for witness in self.witnesses[middle:end]:
                witness.append((left, None))
            self.open.append((height + 1, digest(left + right), first, end))

    def close(self, height: int = 0) -> str:
        """Ends the stream: the last subtree rises alone until it meets its left
        neighbour, and the whole at least to ``height``. Returns the root."""
        while len(self.open) > 1 or self.open[0][0] < height:
            own, root, first, end = self.open.pop()
            for witness in self.witnesses[first:end]:
                witness.append((None, None))
            self.open.append((own + 1, digest(root), first, end))
            self.join_equal()
        return self.open[0][1]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one block; rows come sorted by tree and place."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), (x >> BLOCK for x in batch.column("place").to_pylist()), strict=True))
        start = 0
        for i, mine in enumerate(keys):
            if mine != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, key = [], i, mine
        if start < len(keys):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def stream_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each node's witness within its block and, to the block's first node, the root."""
    for block in blocks(batches):
        subtrees = OpenSubtrees()
        for root in block.column("digest").to_pylist():
            subtrees.append(root)
        # Part of a larger tree, a block is as high as its neighbours.
        root = subtrees.close(BLOCK if block.column("nodes")[0].as_py() > 1 << BLOCK else 0)
        sides = [side for witness in subtrees.witnesses for side in witness]
        ends = [0]
        for witness in subtrees.witnesses:
            ends.append(ends[-1] + len(witness))
        flat = pa.StructArray.from_arrays([pa.array([s[i] for s in sides], pa.string()) for i in (0, 1)], ["left", "right"])
        block = block.append_column("witness", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
        block = block.append_column("top", pa.array([root] + [None] * (len(block) - 1), pa.string()))
        yield from block.combine_chunks().to_batches()


def streamed(nodes: DataFrame) -> DataFrame:
    """One level: nodes (tree, place, digest, nodes in the tree, more) with witness and top."""
    placed = nodes.repartition("tree", F.shiftright("place", BLOCK)).sortWithinPartitions("tree", "place")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return placed.mapInArrow(stream_blocks, f"{kinds}, witness array<struct<left:string,right:string>>, top string")


def above(level: DataFrame) -> DataFrame:
    """The roots of a level's blocks, as nodes of the next."""
    return level.where("top IS NOT NULL").select(
        "tree",
        F.shiftright("place", BLOCK).alias("place"),
        F.col("top").alias("digest"),
        F.ceil(F.col("nodes") / (1 << BLOCK)).alias("nodes"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0 in ``order`` within ``tree``, and ``nodes``, the
    tree's count. Rows are dealt in ranges; a place is the row's number in its
    range plus the tree's rows in ranges before, so that no tree is one task's."""
    # Equal rows get a number, which lets ranges cut them too.
    keys = ["tree", *order, "_copy"]
    ranged = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = durable(
        ranged.withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).drop("_copy"), "op11-places"
    )
    sizes = numbered.groupBy("tree", "_range").agg(F.count("*").alias("_size"), F.min("_row").alias("_first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("nodes", F.sum("_size").over(tree))
    return (
        numbered.join(sizes.drop("_size"), ["tree", "_range"])
        .withColumn("place", F.col("_before") + F.col("_row") - F.col("_first"))
        .drop("_range", "_row", "_first", "_before")
    )


@dataclass
class Trees:
    """``levels``: nodes with their witnesses within blocks, the leaves first; ``roots``: one node a tree."""

    levels: list[DataFrame]
    roots: DataFrame


def grown(nodes: DataFrame) -> Trees:
    levels = []
    while True:
        levels.append(durable(streamed(nodes), "op11-level"))
        nodes = above(levels[-1])
        if (nodes.agg(F.max("nodes")).first()[0] or 1) == 1:
            return Trees(levels, nodes)


def append(old: Trees, rows: DataFrame, order: list[str]) -> Trees:
    """``old`` with more leaves, those of each tree after the ones it has. Blocks that
    were complete stay as they are, at every level."""
    same = [f.name for f in rows.schema.fields]
    had = old.levels[0].groupBy("tree").agg(F.max("place").alias("_last"), F.max(F.struct(*order)).alias("_greatest"))
    late = placed(rows, order).join(had, "tree", "left")
    late = durable(
        late.withColumn("_before", F.coalesce(F.col("_last") + 1, F.lit(0)))
        .withColumn("place", F.col("place") + F.col("_before"))
        .withColumn("nodes", F.col("nodes") + F.col("_before")),
        "op11-late",
    )
    early = late.where(F.struct(*order) < F.col("_greatest")).first()
    if early:
        raise ValueError(f"{[early[x] for x in order]} comes before a leaf that its tree has")
    fresh = late.select(*same, "place", "nodes")
    levels = []
    for k in range(10**9):
        before = old.levels[k] if k < len(old.levels) else old.roots if k == len(old.levels) else None
        totals = fresh.groupBy("tree").agg(F.max("nodes").alias("nodes"))
        touched = fresh.select("tree", F.shiftright("place", BLOCK).alias("_block")).distinct()
        kept, again = None, fresh
        if before is not None:
            more = before.withColumn("_block", F.shiftright("place", BLOCK))
            own = [c for c in fresh.columns if c != "nodes"]
            replaced = more.join(touched, ["tree", "_block"], "left_semi").join(fresh.select("tree", "place"), ["tree", "place"], "left_anti")
            again = fresh.unionByName(replaced.select(*own).join(totals, "tree"))
            kept = more.join(touched, ["tree", "_block"], "left_anti").drop("_block")
            if "witness" not in before.columns:  # trees that did not grow, one level higher
                again, kept = again.unionByName(kept.select(*fresh.columns)), None
        changed = durable(streamed(again), "op11-level")
        if kept is not None:
            kept = kept.drop("nodes").join(
                before.groupBy("tree").agg(F.max("nodes").alias("_old")).join(totals, "tree", "left").select("tree", F.coalesce("nodes", "_old").alias("nodes")),
                "tree",
            )
            levels.append(durable(changed.unionByName(kept), "op11-level"))
        else:
            levels.append(changed)
        roots = above(levels[-1])
        if (roots.agg(F.max("nodes")).first()[0] or 1) == 1:
            return Trees(levels, roots)
        fresh = above(changed)


def witnesses(trees: Trees, roots: DataFrame) -> DataFrame:
    """Leaves with whole witnesses. ``roots``: tree, witness, and what else each leaf of
    the tree gets. From the top down, so a join's key has a block's rows at most."""
    found = roots.withColumn("place", F.lit(0).cast("long"))
    for level in reversed(trees.levels):
        upper = found.drop("digest").withColumnsRenamed({"witness": "_upper", "place": "_parent"})
        level = level.drop("nodes", "top").withColumn("_parent", F.shiftright("place", BLOCK))
        found = level.join(upper, ["tree", "_parent"]).withColumn("witness", F.concat("witness", "_upper")).drop("_upper", "_parent")
    return found


def proofs(trees: Trees) -> DataFrame:
    """Every leaf with subroot, root and witness: its siblings (left, right) from the
    leaf over its tree's root to the root of all."""
    subroots = trees.roots.select("tree", F.col("digest").alias("subroot"))
    top = grown(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest")), ["name"]))
    root = top.roots.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("witness"), F.col("digest").alias("root"))
    highest = durable(
        witnesses(top, root).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "witness"), "op11-roots"
    )
    return witnesses(trees, highest)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its siblings give."""
    side = lambda x: F.coalesce(x, F.lit(""))
    return F.aggregate(witness, leaf, lambda own, w: F.sha2(F.concat(side(w["left"]), own, side(w["right"])), 256))


def row_digest(columns: list[Column]) -> Column:
    """Hash of a row: each value with its length in bytes, or - for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def tree_key(column: str) -> Column:
    """Sorts as the column does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def leaves(docs: DataFrame, columns: list[str] = COLUMNS, tree: str = "lang", order: str = "doc_id", more: dict[str, Column] | None = None) -> DataFrame:
    """Leaves of ``docs``, to be placed: tree, ``order``, digest and the columns of ``more``."""
    hashed = docs.select(
        tree_key(tree).alias("tree"), F.col(order).alias("order"), row_digest([F.col(c) for c in columns]).alias("digest"), *[c.alias(n) for n, c in (more or {}).items()]
    )
    return durable(hashed, "op11-leaves")


#: Nulls come first in the order of a tree; of one id, leaves go by their hashes.
ORDER = ["order", "digest"]


def manifest(docs: DataFrame, columns: list[str] = COLUMNS, tree: str = "lang", order: str = "doc_id", more: dict[str, Column] | None = None) -> Trees:
    """The trees of ``docs``: a row's leaf hashes ``columns``; rows with one value of
    ``tree`` form a tree in ``order``.

    Other columns are ignored, whatever their names. Nulls hash as ``-``, texts whole
    whatever their length; a null ``tree`` is a tree of its own, the first. Rows of one
    ``order`` value, null (first) included, stand by their hashes; repeated rows are
    leaves each. An empty table has no trees.
    """
    return grown(placed(leaves(docs, columns, tree, order, more), ORDER))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    # Wide enough for one more than any long.
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    n_chars = F.col("n_chars").cast("decimal(20,0)") + F.when(tampered, 1).otherwise(0)
    changed = row_digest([n_chars if c == "n_chars" else F.col(c) for c in COLUMNS])
    found = proofs(manifest(docs, more={"changed": changed}))
    siblings = F.transform("witness", lambda w: F.concat(F.coalesce(w["left"], F.lit("")), F.coalesce(w["right"], F.lit(""))))
    return found.select(
        F.col("order").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.concat_ws("", siblings), 256).alias("proof_sha256"),
        folded(F.col("changed"), F.col("witness")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 a bit at a time; the trees level by level.
SQL = """
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 7 = 0 AS tampered
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), parts AS (
  SELECT d.doc_id, d.lang, coalesce(octet_length(encode(d.doc_id::VARCHAR))::VARCHAR || ':' || d.doc_id::VARCHAR, '-')
    || coalesce(octet_length(encode(source))::VARCHAR || ':' || source, '-') || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-') AS head,
    n_chars::DECIMAL(20,0)::VARCHAR AS n, (n_chars::DECIMAL(20,0) + CASE WHEN tampered THEN 1 ELSE 0 END)::VARCHAR AS m,
    coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-') AS tail
  FROM documents d LEFT JOIN crc USING (doc_id)
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(length(n)::VARCHAR || ':' || n, '-') || tail) AS leaf,
    sha256(head || coalesce(length(m)::VARCHAR || ':' || m, '-') || tail) AS changed FROM parts
), low AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM low
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n
), subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS level, place, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, place // 2, n
), climbing AS (
  SELECT doc_id, tree, place AS leaf_place, leaf, changed AS own, '' AS proof, 0 AS level, place, (SELECT max(level) FROM nodes x WHERE x.tree = low.tree) AS height FROM low
  UNION ALL
  SELECT c.doc_id, c.tree, leaf_place, leaf, sha256(CASE WHEN c.place % 2 = 1 THEN s.digest || own ELSE own || coalesce(s.digest, '') END),
    proof || coalesce(s.digest, ''), c.level + 1, c.place // 2, height
  FROM climbing c LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.place = xor(c.place, 1::BIGINT) WHERE c.level < height
), middle AS (
  SELECT c.doc_id, c.tree, leaf_place, leaf, own, proof, s.place, subroot FROM climbing c JOIN subroots s USING (tree) WHERE level = height
), rising AS (
  SELECT *, 0 AS level FROM middle
  UNION ALL
  SELECT doc_id, tree, leaf_place, leaf, sha256(CASE WHEN r.place % 2 = 1 THEN s.digest || own ELSE own || coalesce(s.digest, '') END),
    proof || coalesce(s.digest, ''), r.place // 2, subroot, r.level + 1
  FROM rising r LEFT JOIN top s ON s.level = r.level AND s.place = xor(r.place, 1::BIGINT) WHERE r.level < (SELECT max(level) FROM top)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified
FROM rising, (SELECT digest AS root FROM top WHERE n = 1) WHERE level = (SELECT max(level) FROM top)
"""

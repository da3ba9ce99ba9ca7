"""Merkle trees against a plain version, and appending against building at once."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpus_frames import SCHEMA, docs, none  # noqa: F401  fixtures

from scriptledger.llm import op11_manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)]
    return h("".join(values))


def climb(digests):
    """Root, and siblings of each leaf from the bottom."""
    siblings = [[] for _ in digests]
    members = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        upper, groups = [], []
        for i in range(0, len(digests), 2):
            run = digests[i : i + 2]
            for k in range(len(run)):
                for m in members[i + k]:
                    siblings[m].append([(0, x) if j < k else (1, x) for j, x in enumerate(run) if j != k])
            upper.append(h("".join(run)))
            groups.append([m for g in members[i : i + 2] for m in g])
        digests, members = upper, groups
    return digests[0], siblings


def fold(own, siblings):
    for level in siblings:
        own = h("".join(x for side, x in level if side == 0) + own + "".join(x for side, x in level if side == 1))
    return own


def plain(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found, subroots = [], []
    for lang in order:
        mine = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subroot, siblings = climb([leaf(*r) for r in mine])
        subroots.append(subroot)
        found.append((mine, subroot, siblings))
    root, above = climb(subroots)
    out = []
    for (mine, subroot, siblings), more in zip(found, above, strict=True):
        for row, own in zip(mine, siblings, strict=True):
            whole = own + more
            doc_id, text, lang, source, n_chars = row
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
            folded = fold(leaf(doc_id, text, lang, source, n_chars + tampered if n_chars is not None else None), whole)
            proof = h("".join(x for level in whole for _, x in level))
            out.append((doc_id, leaf(*row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def queried(spark, frame, tmp_path, monkeypatch):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return op11_manifest.query(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def many(n, seed=5):
    draw = random.Random(seed)
    langs = ["en"] * 6 + ["de", "fr", None, "", "zz", "ü"]
    return [(i, f"text {i} é" if i % 5 else None, draw.choice(langs), draw.choice(["a", None]), draw.choice([None, i, 7])) for i in range(n)]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_proofs_equal_a_plain_version(spark, docs, tmp_path, monkeypatch, height):  # noqa: F811
    monkeypatch.setattr(op11_manifest, "BLOCK", height)
    extra = spark.createDataFrame([*many(75), (None, "x", "en", None, 2**63 - 1), (None, "x", "en", None, 1)], SCHEMA)
    frame = docs.unionByName(extra)
    rows = [tuple(r) for r in frame.collect()]
    assert got(queried(spark, frame, tmp_path, monkeypatch)) == plain(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 8, 9, 16, 17, 31])
def test_open_subtrees_at_every_size(count):
    digests = [h(str(i)) for i in range(count)]
    stream = op11_manifest.OpenSubtrees()
    for x in digests:
        stream.append(x)
    root, siblings = climb(digests)
    assert stream.close() == root
    assert [[[(0, x) for x in [left] if x] + [(1, x) for x in [right] if x] for left, right in w] for w in stream.witnesses] == siblings


def test_a_lone_leaf_is_the_root(spark, tmp_path, monkeypatch):
    (row,) = queried(spark, spark.createDataFrame([(3, "a", "en", "s", 1)], SCHEMA), tmp_path, monkeypatch).collect()
    assert row.leaf == row.subroot == row.root == leaf(3, "a", "en", "s", 1)
    assert row.proof_sha256 == h("") and row.verified


def test_no_rows(spark, none, tmp_path, monkeypatch):  # noqa: F811
    assert queried(spark, none, tmp_path, monkeypatch).collect() == []


def test_columns_with_the_names_used_inside(spark):
    rows = many(20)
    plain_frame = spark.createDataFrame(rows, SCHEMA)
    clashing = plain_frame
    for name in ("tree", "place", "nodes", "digest", "witness", "top", "order", "_copy", "_range"):
        clashing = clashing.withColumn(name, F.lit("x"))
    both = [got(op11_manifest.proofs(op11_manifest.manifest(f)).select("order", "digest", "root")) for f in (plain_frame, clashing)]
    assert both[0] == both[1]


def test_a_tampered_value_no_longer_folds_to_the_root(spark):
    frame = spark.createDataFrame(many(40), SCHEMA)
    found = op11_manifest.proofs(op11_manifest.manifest(frame))
    folded = found.select((op11_manifest.folded(F.col("digest"), F.col("witness")) == F.col("root")).alias("same"), "witness", "root")
    assert all(r.same for r in folded.collect())
    wrong = found.select((op11_manifest.folded(F.sha2("digest", 256), F.col("witness")) == F.col("root")).alias("same"))
    assert not any(r.same for r in wrong.collect())


@pytest.mark.parametrize("cuts", [(16, 40), (1, 2, 3), (8, 9, 64)])
def test_appending_gives_what_building_at_once_gives(spark, monkeypatch, cuts):
    """New trees, trees that outgrow a level, trees that get nothing."""
    monkeypatch.setattr(op11_manifest, "BLOCK", 2)
    rows = many(70)
    whole = op11_manifest.proofs(op11_manifest.manifest(spark.createDataFrame(rows, SCHEMA)))
    ends = [0, *cuts, len(rows)]
    trees = op11_manifest.manifest(spark.createDataFrame(rows[: ends[1]], SCHEMA))
    for a, b in zip(ends[1:], ends[2:], strict=False):
        late = op11_manifest.leaves(spark.createDataFrame(rows[a:b], SCHEMA))
        trees = op11_manifest.append(trees, late, op11_manifest.ORDER)
    columns = ["tree", "order", "place", "digest", "subroot", "root", "witness"]
    assert got(op11_manifest.proofs(trees).select(*columns)) == got(whole.select(*columns))


def test_appending_streams_only_open_blocks(spark, monkeypatch):
    monkeypatch.setattr(op11_manifest, "BLOCK", 2)
    rows = [(i, "t", "en", "a", i) for i in range(64)]
    trees = op11_manifest.manifest(spark.createDataFrame(rows[:62], SCHEMA))
    seen = []
    monkeypatch.setattr(op11_manifest, "streamed", lambda nodes, f=op11_manifest.streamed: seen.append(nodes.count()) or f(nodes))
    op11_manifest.append(trees, op11_manifest.leaves(spark.createDataFrame(rows[62:], SCHEMA)), op11_manifest.ORDER)
    assert seen == [4, 4, 4]


def test_appended_rows_must_come_last(spark):
    trees = op11_manifest.manifest(spark.createDataFrame([(5, "t", "en", "a", 1)], SCHEMA))
    with pytest.raises(ValueError, match="comes before"):
        op11_manifest.append(trees, op11_manifest.leaves(spark.createDataFrame([(4, "t", "en", "a", 1)], SCHEMA)), op11_manifest.ORDER)

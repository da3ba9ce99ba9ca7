"""Jaccard join, substring removal, top-k and fingerprints against brute force."""

import hashlib
import os
import random
import time
import tracemalloc
import zlib
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_frames import docs, none, small_documents  # noqa: F401  fixtures

from scriptledger.llm import op4_fingerprints, op5_topk, op6_jaccard, op9_substrings
from scriptledger.llm.components import connected
from scriptledger.llm.shared import Words


def test_words_split_and_hash_like_bytes():
    texts = ["a  b\tc", None, "", " lead Trail ", " nb sp x\x0by", "é" * 50 + " A a"]
    words = Words(pa.array(texts))
    for i, text in enumerate(texts):
        parts = (text or "").encode().split()
        a, b = words.offsets[i : i + 2]
        assert [bytes(words.data[s:e]) for s, e in zip(words.starts[a:b], words.ends[a:b])] == parts
    hashed, lower = words.hashes(), words.hashes(lower=True)
    strings = [bytes(words.data[s:e]) for s, e in zip(words.starts, words.ends)]
    assert len(set(hashed.tolist())) == len(set(strings))
    assert len(set(lower.tolist())) == len({s.lower() for s in strings})
    sliced = Words(pa.array(["skip", *texts]).slice(1))
    assert (sliced.hashes() == hashed).all()


def near_copies(n=40, groups=3, seed=1):
    """Groups of texts with a few words exchanged, around the threshold."""
    rng = random.Random(seed)
    found = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 18))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            found.append(" ".join(copy))
    found += [found[0]] * 5 + ["a b", "A B", "c d e", "", " ", None, "shared phrase of many words here " * 3]
    return [(i * 3 + 1, t) for i, t in enumerate(found)]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_components_equal_brute_force(spark, k, percent):
    rows = near_copies(seed=percent)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("key", F.lit("x"))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_jaccard.jaccard_components(frame, k, percent).collect()}
    assert found == brute_components(rows, k, percent)


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        common = rng.integers(0, 1 << 63, rng.integers(0, 200)).astype(np.uint64)
        left = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 20).astype(np.uint64)]))
        right = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 9).astype(np.uint64)]))
        unlike = (op6_jaccard.sketch(left, 60)[0] != op6_jaccard.sketch(right, 60)[0]).sum()
        assert unlike <= len(np.setxor1d(left, right))


def test_jaccard_edge_cases(docs, none):
    found = op6_jaccard.jaccard_components(docs).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 10
    assert by_id[2].component_id == 1 and by_id[5].n_shingles == 1
    for empty in (3, 4, 9):
        assert (by_id[empty].n_shingles, by_id[empty].component_id) == (0, empty)
    assert op6_jaccard.jaccard_components(none).count() == 0


def test_connected(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (7, 7), (3, 20)] + [(100, 101 + i) for i in range(50)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[n] for n in (1, 2, 3, 20)} == {1} and {found[n] for n in (8, 9, 10)} == {8}
    assert all(found[100 + i] == 100 for i in range(51))


def brute_removal(rows, k):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in split:
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def test_removed_windows_equal_brute_force(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = [f"o{rng.randrange(40)}" for _ in range(rng.randrange(0, 120))]
        at = rng.randrange(len(own) + 1)
        cut = rng.randrange(0, 50)
        rows.append((i, " ".join(own[:at] + passage[cut : cut + rng.randrange(0, 40)] + own[at:])))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, None), (203, "same " * 40), (204, "same " * 15)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(0)).repartition(5)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in op9_substrings.remove_repeated_windows(frame, 13).collect()}
    assert found == brute_removal(rows, 13)


def test_substring_edge_cases(docs, none):
    found = op9_substrings.remove_repeated_windows(docs).collect()
    kept = sorted((r.doc_id, r.n_words, r.n_removed) for r in found)
    assert kept[0] == kept[1] and kept[0][2] == 0  # a repeated row is one document
    assert dict((r.doc_id, r.kept) for r in found)[2] == ""
    assert op9_substrings.remove_repeated_windows(none).count() == 0


def test_windows_of_a_chunk_are_sent_in_the_order_of_texts_within_bounded_memory():
    draw = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(50_000)])
    texts = [" ".join(draw.choice(words, 2_000)) for _ in range(800)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(800), pa.int64()), "text": texts, "crc": pa.array(range(800), pa.int64())})
    width = op9_substrings.SEGMENT
    full = np.full(op9_substrings.ROWS * width // 8, 255, np.uint8)
    run = op9_substrings.repeated_windows(13, width, SimpleNamespace(value=zlib.compress(full.tobytes(), 1)))
    tracemalloc.start()
    rows = sent = 0
    for out in run(iter([batch])):
        spot = out.column("spot").to_numpy()
        assert (np.diff(spot) > 0).all()
        rows, sent = rows + len(spot), sent + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 800 * (2_000 - 12)
    assert sent > 1 and peak < 40 * (4 << 20)


def test_sketch_never_estimates_too_little():
    """Cells hit twice are set wherever a window is repeated, also across chunks."""
    width = 1 << 18
    once = np.arange(0, 40, dtype=np.int64)
    blob = op9_substrings.gaps(once)
    assert (op9_substrings.ungaps(blob) == once).all()
    batch = pa.RecordBatch.from_pydict({"segment": pa.array([0, 0], pa.int32()), "once": [blob, op9_substrings.gaps(once[:5])], "twice": [b"", op9_substrings.gaps(np.array([99]))]})
    (out,) = op9_substrings.merge_sketches(iter([batch]))
    bits = np.unpackbits(np.frombuffer(out.column("bits")[0].as_py(), np.uint8))
    assert set(np.flatnonzero(bits)) == {0, 1, 2, 3, 4, 99} and width >= len(bits)


def brute_top(rows, k=10):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    out = {}
    for q, v in good:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_products_equal_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * np.exp(spread * rng.normal())).astype(np.float32).tolist()) for i in range(2500)]
    rows[700] = (700, rows[100][1])
    rows += [(3000, None), (3100, [None] * 8), (3200, [float("nan")] * 8), (3300, [0.0] * 8), (3400, [1.0, 2.0]), (3401, [2.0, 2.0]), (None, rows[1][1]), (3500, [])]
    frame = spark.createDataFrame(rows, "id long, vector array<float>").withColumn("length", F.lit("clash"))
    found = {}
    for r in op5_topk.top_products(frame, F.pmod("id", F.lit(100)) == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in found.items()} == brute_top(rows)


def test_top_products_of_hot_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [3.0, -4.0]) for i in range(300)], "id long, vector array<float>")
    found = op5_topk.top_products(same, F.col("id") == 100).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == list(range(10))
    assert op5_topk.top_products(same.where("false"), F.col("id") == 100).count() == 0


def test_top_products_of_files_in_reverse_order(spark, monkeypatch):
    """One partition and one Arrow batch over several sorted files, those of the shorter vectors first."""

    def reversed_files(frame, name):
        written = op5_durable(frame, name)
        rows = written.toPandas().sort_values(["length", "id"], ascending=[False, True])
        pieces = [rows.iloc[i : i + 300] for i in range(0, len(rows), 300)]
        files = [spark.createDataFrame(p, written.schema).coalesce(1) for p in reversed(pieces)]
        return reduce(DataFrame.unionAll, files).coalesce(1)

    op5_durable = op5_topk.durable
    monkeypatch.setattr(op5_topk, "durable", reversed_files)
    monkeypatch.setattr(op5_topk, "SEED_VECTORS", 16)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * np.exp(1.5 * rng.normal())).tolist()) for i in range(2500)]
    found = {}
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    for r in op5_topk.top_products(frame, F.pmod(F.col("id"), F.lit(100)) == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in found.items()} == brute_top(rows)


def test_entropy_of_every_window():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 110, 300), np.full(90, 46), rng.integers(0, 256, 200)]).astype(np.uint8)
    levels = op4_fingerprints.entropy_levels(data)
    for i in range(len(levels)):
        _, counts = np.unique(data[i : i + 64], return_counts=True)
        p = counts / 64
        assert abs(levels[i] - 1000 * -(p * np.log2(p)).sum() / 6) < 1.01


def test_fingerprints(spark, small_documents):
    found = {r.doc_id: r for r in op4_fingerprints.fingerprint_neighbours(small_documents).collect()}
    texts = sorted(((r.doc_id, r.text or "") for r in small_documents.collect()), reverse=True)
    alike = {}
    for (i, text), (_, follower) in zip(texts, texts[1:] + texts[:1]):
        n = len(text) // 3
        edited = text[: len(text) - n] + follower[:n]
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i].near_next <= 1 and 0 <= found[i].near_edited <= 1
        alike.setdefault(text, set()).add(found[i].fingerprint)
    assert all(len(prints) == 1 for prints in alike.values())
    long = [r for r in found.values() if r.n_chars > 1000]
    assert np.median([r.near_edited for r in long]) > 0.5 > 0.1 > np.median([r.near_next for r in long])


def test_fingerprint_edge_cases(spark, docs, none):
    found = op4_fingerprints.fingerprint_neighbours(docs.withColumn("bucket", F.lit(5))).collect()
    assert sorted(r.doc_id for r in found) == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[2].near_next == 1.0
    assert by_id[3].fingerprint == by_id[4].fingerprint == "" and by_id[4].near_next == 1.0
    assert op4_fingerprints.fingerprint_neighbours(none).count() == 0
    alone = op4_fingerprints.fingerprint_neighbours(spark.createDataFrame([(None, "a lone text of some words")], "doc_id long, text string")).collect()
    assert alone[0].near_next == 1.0


def test_topk_of_large_components_is_exact_or_an_error(spark):
    """Scores beyond doubles, finite components beyond longs, and scores beyond longs."""
    draw = np.random.default_rng(6)
    rows = [(i * 10, [float(x) for x in draw.uniform(-1e6, 1e6, 3)]) for i in range(60)]
    schema = "id long, vector array<double>"
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    found = op5_topk.top_products(spark.createDataFrame(rows, schema).repartition(3), F.pmod("id", F.lit(100)) == 0).collect()
    for query in (i for i in whole if i % 100 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(whole[query], v, strict=True)), i) for i, v in whole.items() if i != query))[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)] == scores
    assert max(r.score for r in found) > 2**53
    wide = [(100, [0.0, 5.0]), (1, [1e17, 1.0]), (2, [-1e17, 2.0]), (3, [1.0, 1.0])]
    got = op5_topk.top_products(spark.createDataFrame(wide, schema), F.col("id") == 100).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, 5120 * 2048), (1, 5120 * 1024), (3, 5120 * 1024)]
    for beyond in ([(100, [3e12, 1.0]), (1, [3e12, 2.0])], [(100, [1e308]), (1, [1.0])]):
        with pytest.raises(Exception, match="beyond a"):
            op5_topk.top_products(spark.createDataFrame(beyond, schema), F.col("id") == 100).collect()


def just_below(n, words=60):
    """Texts of one base with every tenth word, at a place of its own, exchanged: alike, yet below 85 %."""
    base = [f"b{i}" for i in range(words)]
    found = []
    for i in range(n):
        copy = list(base)
        for place in (7, 23, 39, 55):
            copy[place] = f"own{i}x{place}"
        found.append(" ".join(copy))
    return found


def test_rows_stay_linear_in_near_copies_below_the_similarity(spark, monkeypatch):
    texts = just_below(3000) + [t + " tail" for t in just_below(3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    written = {}

    def counting(frame, name):
        table = op6_jaccard_durable(frame, name)
        written[name] = max(written.get(name, 0), table.count())
        return table

    op6_jaccard_durable = op6_jaccard.durable
    monkeypatch.setattr(op6_jaccard, "durable", counting)
    found = {r.doc_id: r.component_id for r in op6_jaccard.jaccard_components(frame, 4, 85).collect()}
    assert all(found[i] == i for i in range(3000))
    assert [found[3000 + i] for i in range(3)] == [0, 1, 2]
    classes = len(texts)
    assert written["op6-maybe"] > 0
    assert all(written[name] <= 4 * classes for name in ("op6-maybe", "op6-left", "op6-more", "op6-checked"))


@pytest.mark.parametrize("block, size", [(4, 16 << 20), (1024, 2000)])
def test_small_blocks_find_the_same_links(spark, monkeypatch, block, size):
    monkeypatch.setattr(op6_jaccard, "BLOCK", block)
    monkeypatch.setattr(op6_jaccard, "BLOCK_BYTES", size)
    rows = near_copies(25, 3, seed=7)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_jaccard.jaccard_components(frame, 4, 85).collect()}
    assert found == brute_components(rows, 4, 85)


def test_sketches_rule_out_large_sets_too(spark):
    """Sets of 4,000 shingles without a common one may differ in 888 at 80 %, more than half of 1,024 bits."""
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 48, 4000, np.uint64) for _ in range(3)]
    sets.append(np.concatenate([sets[0][:3900], rng.integers(0, 1 << 48, 200, np.uint64)]))  # another size of sketch
    n = [len(x) for x in sets]
    zero = pa.array([0] * 4, pa.int32())
    rows = [pa.array([1] * 4), zero, zero, zero, pa.array([10, 11, 12, 13]), pa.array(n, pa.int32()), pa.array([10, 11, 12, 13]), pa.array([op6_jaccard.parities(x) for x in sets])]
    batch = pa.RecordBatch.from_arrays(rows, ["key", "low", "high", "own", "node", "n", "root", "sketch"])
    found = [r for b in op6_jaccard.may_link(80)(iter([batch])) for r in b.to_pylist()]
    assert {r["node"] for r in found} == {10, 13} and {(r["root"], r["other"]) for r in found} >= {(10, 13)}


def test_texts_whose_sketches_differ_in_size_link(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1030)]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate((1030, 1000, 930, 860))] + [(9, "other " * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_jaccard.jaccard_components(frame, 5, 80).collect()}
    assert found == brute_components(rows, 5, 80)


def test_written_tables_leave_no_shuffle_files(spark):
    from scriptledger.sources.scratch import CLEANUP, discard, durable

    def files():
        held = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("|")
        return {x for x in held.split("|") if "/shuffle_" in x}

    before, setting = files(), spark.conf.get(CLEANUP)
    table = durable(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == setting
    assert table.count() == 7
    (folder,) = {x.rsplit("/", 1)[0].removeprefix("file://") for x in table.inputFiles()}
    discard(table)
    assert not os.path.exists(folder)


def test_a_filter_takes_as_few_jobs_with_many_partitions(spark):
    """A job for each partition took most of a run on tables dealt over many."""
    nodes = spark.range(5000).select((F.col("id") * 7919).alias("node"))
    context, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("op6-filter", "")
    try:
        bits = op6_jaccard.filter_of(nodes)
        jobs = len(context.statusTracker().getJobIdsForGroup("op6-filter"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert jobs < 10
    at = np.flatnonzero(np.unpackbits(bits))
    assert at.tolist() == sorted({7919 * i % op6_jaccard.FILTER_BITS for i in range(5000)})

"""Keys in parcels, and the suffix tree's tasks on them."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators_texts import local_scores

from scriptledger.llm import op2_suffix_tree, parcels
from scriptledger.llm.shared import mix


def ordered(batches, size):
    """As Spark deals them out: by part and kind, in batches of ``size`` rows."""
    table = pa.Table.from_batches(batches).sort_by([("part", "ascending"), ("kind", "ascending")])
    return table.combine_chunks().to_batches(max_chunksize=size)


def test_keys_and_columns_are_read_as_they_were_packed():
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(0, 1 << 64, 5000, np.uint64), np.array([0, 1, (1 << 64) - 1], np.uint64)])
    values, numbers = rng.normal(0, 5, len(keys)), rng.integers(-9, 9, len(keys))
    pieces = [(7, keys[a : a + 700], [values[a : a + 700], parcels.fixed(values[a : a + 700]), numbers[a : a + 700]]) for a in range(0, len(keys), 700)]
    batches = [*parcels.dealt(iter(pieces[:4]), 5), *parcels.dealt(iter(pieces[4:]), 5), parcels.packed(8, np.sort(keys), [], 5)]
    seen, found = [], []
    for group in parcels.grouped(iter(ordered(batches, 3))):
        seen.append(set(group.table.column("part").to_pylist()))
        found.append(group.take(7, "f8", "s6", "i8"))
        assert (np.sort(found[-1][0]) == np.sort(group.take(8)[0])).all()
    # Each part is whole in one group.
    assert sorted(x for parts in seen for x in parts) == list(range(32))
    got, plain, six, whole = (np.concatenate(x) for x in zip(*found, strict=True))
    order, before = np.argsort(got), np.argsort(keys)
    assert (got[order] == keys[before]).all() and (plain[order] == values[before]).all() and (whole[order] == numbers[before]).all()
    assert parcels.units(six)[order] / parcels.UNITS == pytest.approx(values[before], abs=1e-12)
    assert len(group.take(9, "f8")[1]) == 0


def test_a_suffix_is_told_from_gram_and_context():
    rng = np.random.default_rng(2)
    context, suffix = rng.integers(0, 1 << 64, (2, 1000), np.uint64)
    assert (op2_suffix_tree.second_of(op2_suffix_tree.joined_hash(context, suffix), context) == suffix).all()


def test_no_row_for_each_gram():
    """Grams are shuffled by the thousand; a row each took most of the time."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 1000)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array([True] * 100), pa.array(range(100), pa.int64()), pa.array(texts)], ["doc_id", "training", "row", "text"])
    sent, head = SimpleNamespace(value=np.full(1 << 17, 255, np.uint8)), SimpleNamespace(value=[np.zeros(1, np.int64)] + [np.zeros(1)] * 3)
    for run in (op2_suffix_tree.word_counts, op2_suffix_tree.counted_grams(3, sent), op2_suffix_tree.scored(4, head, sent)):
        assert sum(found.num_rows for found in run(iter([batch]))) < 200


def test_counts_beyond_a_byte_are_whole():
    texts = pa.RecordBatch.from_arrays([pa.array(["a b " * 700, None, "", "B a"])], ["text"])
    least, bits = 2, op2_suffix_tree.LEAST_BITS
    batches = [*op2_suffix_tree.word_counts(iter([texts]))]
    found = pa.Table.from_batches([*op2_suffix_tree.frequent_grams(least, bits)(iter(ordered(batches, 2)))])
    words, n = parcels.Parcels(found.to_batches()).take(op2_suffix_tree.WORD, "i8")
    assert sorted(n) == [4, 4, 701, 701] and set(words) > {op2_suffix_tree.BEGIN, op2_suffix_tree.AFTER}
    suffix, context, n = parcels.Parcels(found.to_batches()).take(op2_suffix_tree.GRAM, "u8", "i8")
    # a b, b a, and the two empty texts.
    assert sorted(n) == [2, 700, 700]
    assert dict(zip(context, suffix, strict=True))[op2_suffix_tree.BEGIN] == op2_suffix_tree.AFTER


def test_answers_of_many_sources_add_up():
    """A key with values as context and as gram, one that stands twice in a text, and absent ones."""
    keys = mix(np.arange(200, dtype=np.uint64))
    order = np.argsort(keys)
    words = np.sort(mix(np.arange(1000, 1010, dtype=np.uint64)))
    values = [parcels.packed(op2_suffix_tree.VALUE, keys[order], [parcels.fixed(np.full(200, x))], 6) for x in (0.25, -1.0)]
    batches = [*values, parcels.packed(op2_suffix_tree.WORD, words, [np.full(10, 99)], 6)]
    for source in range(5):
        asked = np.concatenate([keys[:50], keys[:1], words[:2], mix(np.arange(5000, 5005, dtype=np.uint64))])
        order = np.argsort(asked)
        place = np.where(np.arange(len(asked)) % 2, 3, 65535)[order].astype(np.uint16)
        batches.append(parcels.packed(op2_suffix_tree.REQUEST, asked[order], [place], 6, source * 1000))
    found = pa.Table.from_batches([*op2_suffix_tree.answered(iter(ordered(batches, 7)))])
    assert sorted(found.column("source").to_pylist()) == [0, 1000, 2000, 3000, 4000]
    place = parcels.content(found.column("c0"), "u2")
    extra, base, known = (parcels.content(found.column(c), "i8") for c in ("c2", "c3", "c4"))
    # Places 65535 and 3: 26 and 25 times both values, one word each.
    assert {(p, e / parcels.UNITS, b / parcels.UNITS, k) for p, e, b, k in zip(place, extra, base, known, strict=True)} == {(65535, -0.75 * 26, 2.0, 1), (3, -0.75 * 25, 2.0, 1)}


@pytest.mark.parametrize(("bits", "slices"), [(1, 1), (11, 4)])
def test_scores_do_not_depend_on_parts_and_slices(spark, monkeypatch, bits, slices):
    monkeypatch.setattr(op2_suffix_tree, "LEAST_BITS", bits)
    monkeypatch.setattr(op2_suffix_tree, "SLICES", slices)
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.4, 50), 90)) for _ in range(40)]
    texts += [None, "", "", "w1 " * 600, texts[0], texts[0], "never seen"]
    training = [i for i in range(len(texts)) if i % 4]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = op2_suffix_tree.score_texts(frame, F.col("doc_id") % 4 != 0).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))
    scores = {r.doc_id: r.score for r in found}
    assert [scores[i] for i in range(len(texts))] == pytest.approx(local_scores(texts, training, 2), rel=1e-9)

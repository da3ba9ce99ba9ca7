"""Token counts against the library's."""

import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_frames import docs, none, small_documents  # noqa: F401  fixtures

from scriptledger.llm import op13_token_counts

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
    SPEC = file.read()
ODD = [*"ab'srevltdmlS 1\n\t!\"é日🙂²", "  ", "'s", "'ll", "'re", "'ve'd", "\r\n", "͸", "࢏", "\U00031350", "\x1c", "​", "\x85", "　"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_str(SPEC)


def library(tokenizer, texts):
    return [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def compared(frame, tokenizer):
    rows = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
    counts = library(tokenizer, [t for _, t in rows])
    want = sorted(((i, len(t.encode()), n) for (i, t), n in zip(rows, counts, strict=True)), key=str)
    got = sorted(map(tuple, op13_token_counts.token_counts(frame, SPEC).select("doc_id", "n_bytes", "n_tokens").collect()), key=str)
    assert got == want


def test_documents(spark, small_documents, tokenizer):  # noqa: F811
    compared(small_documents, tokenizer)


@pytest.mark.parametrize("head", [1 << 18, 40, 0])
def test_nulls_copies_and_odd_texts(spark, docs, tokenizer, monkeypatch, head):  # noqa: F811
    """With all, some and none of the pre-tokens broadcast."""
    monkeypatch.setattr(op13_token_counts, "HEAD", head)
    odd = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext", "  \n\n x", "it's 'S we'll' ''s", "x" * 300 + " " + "=" * 400, "nul\x00byte", "͸" * 50]
    extra = spark.createDataFrame([(None if i == 3 else i + 100, t, None, None, None) for i, t in enumerate(odd * 2)], docs.schema)
    compared(docs.unionByName(extra).repartition(3), tokenizer)


def test_long_texts_in_parts(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(op13_token_counts, "PART", 300)
    monkeypatch.setattr(op13_token_counts, "CHUNK", 1000)
    draw = random.Random(2)
    words = ["alpha", "it's", "  two", "\n", "12ab", "x" * 70, "<|endoftext|>", "é", "日本"]
    texts = [" ".join(draw.choice(words) for _ in range(n)) for n in (3000, 10, 900, 0, 2500, 1)]
    texts.append("y" * 5000)  # no place to cut
    compared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), tokenizer)


def test_a_long_run_of_letters(spark, tokenizer):
    draw = random.Random(4)
    run = "".join(draw.choice("abcdefgh") for _ in range(100_000))
    compared(spark.createDataFrame([(1, run), (2, run + " " + run)], "doc_id long, text string"), tokenizer)


def test_cut_as_the_library_cuts(tokenizer):
    draw = random.Random(1)
    cut = op13_token_counts.Cutter(SPEC)
    for _ in range(3000):
        segments = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(1, 4))]
        pieces, first = cut.cut(segments)
        got = [pieces.slice(a, b - a).to_pylist() for a, b in zip(first, first[1:], strict=False)]
        assert got == [[s[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(s)] for s in segments]


def test_parts_are_cut_where_nothing_changes(tokenizer, monkeypatch):
    monkeypatch.setattr(op13_token_counts, "PART", 5)
    draw = random.Random(7)
    for _ in range(500):
        text = "".join(draw.choice(ODD + [" ", " a", "b "]) for _ in range(60))
        found = op13_token_counts.parts(text)
        assert "".join(found) == text
        pieces = [p for x in found for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(x)]
        assert pieces == [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_no_rows_and_clashing_columns(spark, none, docs, tokenizer):  # noqa: F811
    assert op13_token_counts.token_counts(none, SPEC).collect() == []
    frame = docs
    for name in ("row", "key", "tokens", "times", "n_bytes", "piece", "texts"):
        frame = frame.withColumn(name, F.lit("x"))
    compared(frame, tokenizer)


def test_other_kinds_of_tokenizers_are_refused():
    spec = json.loads(SPEC)
    spec["normalizer"] = {"type": "Lowercase"}
    with pytest.raises(ValueError, match="byte-level"):
        op13_token_counts.Cutter(json.dumps(spec))

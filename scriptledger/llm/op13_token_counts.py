"""Token counts of texts from counts of distinct pre-tokens.

A byte-level BPE merges within pre-tokens only, so a text's count is the sum over its
distinct pre-tokens of times x tokens. Texts are cut into pre-tokens by classes of
code points that the tokenizer itself was asked for, in numpy. All distinct
pre-tokens of the corpus are counted once by the library's model and kept as a
table. A text's frequencies then meet it: those of the ``HEAD`` pre-tokens that most
texts hold by a broadcast of bounded size, the rest, which no text can make hot, by a
join on the pre-token. No list of ids is made anywhere.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptledger.llm.shared import chunks, documents, durable

#: Pre-tokens broadcast with their counts, each of at most LONG + 1 bytes: 17 MB.
HEAD = 1 << 18
#: Pre-tokens of more bytes are joined by their hash.
LONG = 64
#: Bytes of text cut at a time.
CHUNK = 2 << 20
#: Longer texts are cut into parts of about so many characters.
PART = 1 << 20
LETTER, NUMBER, OTHER, SPACE, UNASKED = range(5)


class Cutter:
    """Pre-tokens of texts as the tokenizer of a byte-level BPE cuts them. The class of a
    code point is found by cutting it together with a letter, a digit and a mark."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        cut = parsed.get("pre_tokenizer") or {}
        added = parsed.get("added_tokens") or []
        if (
            parsed.get("normalizer")
            or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True)
            or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        ):
            raise ValueError("only byte-level tokenizers that cut by the usual pattern, without normaliser, prefix space or stripping tokens")
        self.tokenizer = Tokenizer.from_str(spec)
        self.asked = self.tokenizer.pre_tokenizer
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.classes = np.full(0x110000, UNASKED, np.uint8)

    def ask(self, codes: np.ndarray) -> None:
        for i in range(0, len(codes), 1024):
            some = codes[i : i + 1024].tolist()
            cuts = {span for _, span in self.asked.pre_tokenize_str("".join(f"a{chr(c)}\n1{chr(c)}\n!{chr(c)}\n" for c in some))}
            for k, c in enumerate(some):
                kinds = [kind for kind in (LETTER, NUMBER, OTHER) if (9 * k + 3 * kind, 9 * k + 3 * kind + 2) in cuts]
                self.classes[c] = kinds[0] if kinds else SPACE

    def segments(self, text: str) -> tuple[list[str], int]:
        """Parts of a text that are cut each alone, and the number of added tokens in it."""
        if self.added is None or not self.added.search(text):
            return parts(text), 0
        found = self.added.split(text)
        return [p for x in found if x for p in parts(x)], len(found) - 1

    def cut(self, segments: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens of all segments in order, and the first of each segment (one more than segments)."""
        joined = "".join(segments)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, segments)])
        if not len(codes):
            return pa.array([], pa.large_string()), np.zeros(len(bounds), np.int64)
        kind = self.classes[codes]
        if (kind == UNASKED).any():
            self.ask(np.unique(codes[kind == UNASKED]))
            kind = self.classes[codes]
        starts = np.flatnonzero(self.starts(codes, kind, bounds))
        width = np.ones(len(codes) + 1, np.int64)
        for least in (0x80, 0x800, 0x10000):
            width[1:] += codes >= least
        width[0] = 0
        at = np.cumsum(width, out=width)[np.append(starts, len(codes))]
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(joined.encode()))
        return pieces, np.searchsorted(starts, bounds)

    def starts(self, codes: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|S+(?!non-space)|S+``."""
        n = len(codes)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        space = kind == SPACE
        run = edge[:n].copy()  # a run of one class starts
        run[1:] |= kind[1:] != kind[:-1]
        after_blank = np.zeros(n, bool)  # a blank just before goes with it
        after_blank[1:] = (codes[:-1] == 0x20) & ~edge[1:n]
        start = run & (space | ~after_blank)
        # White space before something: its last character stands apart, or goes with it.
        last = space.copy()
        last[:-1] &= run[1:] & ~edge[1:n]
        last[-1] = False
        start |= last
        self.contractions(codes, kind, start, edge)
        return start

    def contractions(self, codes: np.ndarray, kind: np.ndarray, start: np.ndarray, edge: np.ndarray) -> None:
        """An apostrophe at which a match starts takes s, t, m, d, re, ve or ll with it."""
        n = len(codes)
        places = np.flatnonzero((codes == ord("'")) & start)
        places = places[places + 1 < n]
        places = places[~edge[places + 1]]
        next_ = codes[places + 1]
        one = np.isin(next_, [ord(c) for c in "stmd"])
        wide = places[places + 2 < n]
        wide = wide[~edge[wide + 2]]
        a, b = codes[wide + 1], codes[wide + 2]
        wide = wide[((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))]
        for ends, size in ((places[one], 2), (wide, 3)):
            start[ends + 1] = False
            ends = ends + size
            ends = ends[ends < n]
            # A letter goes on from here; anything else starts where its run does.
            start[ends[kind[ends] == LETTER]] = True

    def tokens(self, piece: str) -> int:
        return len(self.tokenizer.model.tokenize("".join(map(BYTE_CHARACTERS.__getitem__, piece.encode()))))


def parts(text: str) -> list[str]:
    """A long text cut before single blanks between other characters, where a
    pre-token starts whatever stands around."""
    if len(text) <= PART:
        return [text]
    out, start = [], 0
    for found in SINGLE_BLANK.finditer(text):
        if found.start() + 1 - start >= PART:
            out.append(text[start : found.start() + 1])
            start = found.start() + 1
    return [*out, text[start:]]


SINGLE_BLANK = re.compile(r"[A-Za-z] (?=[A-Za-z])")


def byte_characters() -> list[str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others
    in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


BYTE_CHARACTERS = byte_characters()


@lru_cache(maxsize=2)
def cutter(spec: str) -> Cutter:
    return Cutter(spec)


def text_pieces(cut: Cutter, texts: list[str]) -> Iterator[tuple[int, int, pa.DictionaryArray, np.ndarray, np.ndarray]]:
    """Parts of ``texts`` of bounded size: (first text, end, distinct pre-tokens with the codes
    of all, the text that each belongs to, added tokens a text). A long text comes in several parts."""
    segments, owners, added, size, first = [], [], [], 0, 0

    def done(end):
        pieces, firsts = cut.cut(segments)
        owner = np.repeat(np.array(owners, np.int64), np.diff(firsts)) if segments else np.zeros(0, np.int64)
        return first, end, pieces.dictionary_encode(), owner, np.array(added, np.int64)

    for i, text in enumerate(texts):
        own, count = cut.segments(text)
        added.append(count)
        for x in own:
            segments.append(x)
            owners.append(i - first)
            size += len(x)
            if size >= CHUNK:
                yield done(i + 1)
                segments, owners, added, size, first = [], [], [0], 0, i
    if added:
        yield done(len(texts))


def distinct_pieces(spec):
    """Distinct pre-tokens of each part, with the number of texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(spec.value)
        for chunk in chunks(batches, limit=CHUNK):
            for _, _, pieces, owner, _ in text_pieces(cut, chunk.column("text").to_pylist()):
                codes = pieces.indices.to_numpy()
                held = np.unique(owner * len(pieces.dictionary) + codes) % max(1, len(pieces.dictionary))
                texts = np.bincount(held, minlength=len(pieces.dictionary))
                yield pa.RecordBatch.from_arrays([pieces.dictionary.cast(pa.string()), pa.array(texts)], ["piece", "texts"])

    return run


def count_pieces(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(spec.value)
        for batch in batches:
            tokens = [cut.tokens(p) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("texts"), pa.array(tokens, pa.int64())], ["key", "texts", "tokens"])

    return run


def short_key(piece: str) -> str:
    raw = piece.encode()
    return piece if len(raw) <= LONG else "#" + hashlib.sha256(raw).hexdigest()


def frequencies(spec, head):
    """For each text a row with the tokens of its pre-tokens in the head, and one for each
    other distinct pre-token with its times. ``row`` tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(spec.value)
        known, tokens = head.value
        row = TaskContext.get().partitionId() << 33
        for chunk in chunks(batches, limit=CHUNK):
            ids = chunk.column("doc_id")
            sizes = pc.binary_length(chunk.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            last = -1
            for first, end, pieces, owner, added in text_pieces(cut, chunk.column("text").to_pylist()):
                distinct = pieces.dictionary.cast(pa.string())
                pair, times = np.unique(owner * max(1, len(distinct)) + pieces.indices.to_numpy(), return_counts=True)
                text, code = np.divmod(pair, max(1, len(distinct)))
                place = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False)[code]
                here = place >= 0
                sums = added.copy()
                np.add.at(sums, text[here], times[here] * tokens[place[here]])
                places = np.arange(first, end)
                # A text that goes on from the part before has its row already.
                fresh = places > last
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + places), ids.slice(first, end - first), pa.array(np.where(fresh, sizes[first:end], 0)), pa.array(sums), pa.nulls(len(places), pa.string()), pa.array(np.zeros(len(places), np.int64))],
                    FIELDS,
                )
                rest = np.flatnonzero(~here)
                for i in range(0, len(rest), 1 << 16):
                    some = rest[i : i + (1 << 16)]
                    keys = [short_key(p) for p in distinct.take(pa.array(code[some])).to_pylist()]
                    nothing = pa.nulls(len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row + first + text[some]), nothing, nothing, nothing, pa.array(keys, pa.string()), pa.array(times[some])], FIELDS
                    )
                last = end - 1
            row += chunk.num_rows

    return run


FIELDS = ["row", "doc_id", "n_bytes", "tokens", "key", "times"]


def token_counts(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of ``docs``, as the tokenizer
    whose JSON is ``spec`` encodes the text without adding tokens of its own; the
    strings of its added tokens count one each.

    Needs doc_id and text; other columns are ignored. Null and empty texts have no
    tokens. Repeated rows and equal texts are counted each; a null doc_id stays null. A
    text of any length is cut in bounded parts. An empty table gives an empty result.
    """
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(spec)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = rows.select("text").mapInArrow(distinct_pieces(sent), "piece string, texts long").groupBy("piece").agg(F.sum("texts").alias("texts"))
    key = F.when(F.octet_length("piece") <= LONG, F.col("piece")).otherwise(F.concat(F.lit("#"), F.sha2("piece", 256)))
    counted = durable(pieces.select("piece", key.alias("key"), "texts").mapInArrow(count_pieces(sent), "key string, texts long, tokens long"), "op13-pieces")
    most = counted.where(F.octet_length("key") <= LONG + 1).orderBy(F.col("texts").desc(), "key").limit(HEAD).select("key", "tokens").toArrow()
    head = context.broadcast((most.column("key").combine_chunks(), most.column("tokens").to_numpy()))
    found = durable(
        rows.mapInArrow(frequencies(sent, head), "row long, doc_id long, n_bytes long, tokens long, key string, times long"), "op13-frequencies"
    )
    rare = found.where("key IS NOT NULL").join(counted.select("key", F.col("tokens").alias("each")), "key")
    rare = rare.select("row", "doc_id", "n_bytes", (F.col("times") * F.col("each")).alias("tokens"))
    together = found.where("key IS NULL").select("row", "doc_id", "n_bytes", "tokens").unionByName(rare)
    return (
        together.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
        .drop("row")
    )


def query(spark, sf_dir: str, limit: int = 512) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        found = token_counts(documents(spark, sf_dir), file.read())
    return found.withColumn("over_limit", F.col("n_tokens") > limit)

"""Byte-level BPE: encoding by ranked merges of distinct pieces, and decoding in Spark.

Spark splits texts by the pattern. A piece is its bytes, of which the first of the
adjacent pairs of lowest rank is merged until no pair has a rank.

A first pass over the texts counts in how many chunks each distinct piece stands; the
up to ``HEAD`` pieces that most chunks share are merged once for the whole corpus and
sent to all tasks. In the second pass each chunk merges its distinct pieces that are not
sent, and puts the ids of its texts together. Only distinct pieces are shuffled, never texts.

Decoding is a Spark expression: ids pick the bytes of their tokens out of a literal,
and these are joined. Bytes stand there in strings as characters U+0000 to U+00FF.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptledger.llm.shared import durable

#: Pieces of a chunk, after which it ends.
CHUNK_PIECES = 1 << 20
#: Pieces sent to all tasks with their ids, each of at most LONG bytes and ids: about
#: 15 MB for usual words, 170 MB if every piece were LONG and without a merge.
HEAD = 1 << 19
LONG = 64
#: Pieces whose ids are put together at a time, cut between texts.
STEP = 1 << 17
#: Bytes of a piece up to which it is merged in arrays, BLOCK pieces at a time.
SCAN = 128
BLOCK = 1 << 15
NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank per line, the bytes in base 64. Read on the driver."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Merges:
    """Ranks as arrays, and the merges of pieces by them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens, self.ids = pa.array(list(ranks), pa.binary()), np.array(list(ranks.values()), np.int64)
        self.byte = np.array([ranks.get(bytes([b]), NONE) for b in range(256)], np.int64)
        made = {-1: NONE}  # two ids as one number, and the id of both together
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if token[:i] in ranks and token[i:] in ranks:
                    made[ranks[token[:i]] << 32 | ranks[token[i:]]] = rank
        self.pairs = np.array(sorted(made), np.int64)
        self.made = np.array([made[pair] for pair in self.pairs.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.made[at], NONE)

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece start (one more than pieces), and all ids."""
        pieces = pieces.cast(pa.binary())
        own = pc.fill_null(pc.index_in(pieces, value_set=self.tokens), -1).to_numpy(zero_copy_only=False)
        lengths = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
        sizes = np.ones(len(pieces), np.int64)
        parts = []  # numbers of pieces, and their ids
        whole = np.flatnonzero(own >= 0)
        parts.append((whole, self.ids[own[whole]]))
        some = np.flatnonzero((own < 0) & (lengths <= SCAN))
        for a in range(0, len(some), BLOCK):
            mine = some[a : a + BLOCK]
            sizes[mine], ids = self.short(pieces.take(pa.array(mine)))
            parts.append((mine, ids))
        for i in np.flatnonzero((own < 0) & (lengths > SCAN)):
            ids = self.long(pieces[int(i)].as_py())
            sizes[i] = len(ids)
            parts.append((np.array([i]), ids))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(ends[-1], "<u4")
        for mine, ids in parts:
            out[spread(ends[mine], sizes[mine])] = ids
        return ends, out

    def short(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all ids; one merge a piece and step."""
        lengths = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
        ids = self.byte[np.frombuffer(b"".join(pieces.to_pylist()), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        ranks = np.full(len(ids), NONE, np.int64)  # of each part with the next one
        next_too = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[next_too] = self.rank(ids[next_too], ids[next_too + 1])
        over = [(owner[:0], ids[:0])]
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(starts, append=len(ids)))
            on = least != NONE
            if not on.all():
                over.append((owner[~on], ids[~on]))
                ids, owner, ranks, least = ids[on], owner[on], ranks[on], least[on]
            at = np.flatnonzero(ranks == least)
            at = at[np.diff(owner[at], prepend=-1) != 0]  # the first of each piece
            ids[at] = ranks[at]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, owner, ranks = ids[kept], owner[kept], ranks[kept]
            at -= np.arange(len(at))
            ranks[at] = NONE
            for left in (at[at > 0] - 1, at[at < len(ids) - 1]):
                left = left[owner[left] == owner[left + 1]]
                ranks[left] = self.rank(ids[left], ids[left + 1])
        owner, ids = (np.concatenate(x) for x in zip(*over, strict=True))
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(pieces)), ids[order]

    def long(self, piece: bytes) -> list[int]:
        """The same merges in n log n steps. A part is known by its first byte; the heap holds
        pairs as rank and first byte in one number, the current ones and some of earlier."""
        n, ranks = len(piece), self.ranks
        ends, before = list(range(1, n + 1)), list(range(-1, n))

        def rank(a: int) -> int:
            b = ends[a]
            return ranks.get(piece[a : ends[b]], NONE) if b < n else NONE

        rank_at = [rank(a) for a in range(n)]
        heap = [r << 32 | a for a, r in enumerate(rank_at) if r != NONE]
        heapify(heap)
        while heap:
            least = heappop(heap)
            a = least & 0xFFFFFFFF
            if rank_at[a] != least >> 32:
                continue
            b = ends[a]
            ends[a] = ends[b]
            rank_at[b] = NONE
            before[ends[a]] = a
            for x in (before[a], a):
                if x >= 0:
                    rank_at[x] = rank(x)
                    if rank_at[x] != NONE:
                        heappush(heap, rank_at[x] << 32 | x)
        out, a = [], 0
        while a < n:
            out.append(ranks.get(piece[a : ends[a]], NONE))
            a = ends[a]
        return out


def merged_pieces(sent):
    """Pieces with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, ids = sent.value.of(batch.column("piece"))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("piece"), lists], ["piece", "ids"])

    return run


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of up to CHUNK_PIECES pieces together; a text of more stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        counts = pc.list_value_length(batch.column("pieces")).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(counts):
            if size and size + n > CHUNK_PIECES:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, start = [], 0, i
            size += int(n)
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def piece_lists(table: pa.Table) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The number of pieces of each row, and all pieces as numbers of distinct ones."""
    lists = table.column("pieces").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()


def distinct_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in chunked(batches):
        yield pa.RecordBatch.from_arrays([piece_lists(table)[1].dictionary], ["piece"])


def head_of(pieces: DataFrame, sent) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces that stand in at least two chunks, the most shared ones first as far as HEAD
    goes: the pieces, the first id of each (one more than pieces), and all ids."""
    counted = (
        pieces.select("pieces")
        .mapInArrow(distinct_pieces, "piece string")
        .groupBy("piece")
        .agg(F.count("*").alias("chunks"))
        .where((F.col("chunks") > 1) & (F.octet_length("piece") <= LONG))
        # Eighths of powers of two: few whatever the corpus.
        .withColumn("level", F.floor(8 * F.log2("chunks")).cast("int"))
    )
    counted = durable(counted.select("piece", "level"), "op8-pieces")
    least, room = 1 << 20, HEAD
    for level, n in sorted(((r["level"], r["n"]) for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        if n > room:
            break
        least, room = level, room - n
    shared = counted.where(F.col("level") >= least).select("piece").repartition("piece")
    head = durable(shared.mapInArrow(merged_pieces(sent), "piece string, ids array<int>"), "op8-head")
    found = head.toArrow().combine_chunks()
    names, lists = (pa.concat_arrays(found.column(c).chunks or [pa.array([], found.column(c).type)]) for c in ("piece", "ids"))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return names, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), lists.flatten().to_numpy().astype("<u4")


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def encoded(sent, head_sent):
    """Rows of texts with their ids as bytes and as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, (names, firsts, ids_of) = sent.value, head_sent.value
        for table in chunked(batches):
            counts, flat = piece_lists(table)
            # Each distinct piece's first id and their number, in the head's ids or, behind them, the chunk's own.
            place = pc.fill_null(pc.index_in(flat.dictionary, value_set=names), -1).to_numpy(zero_copy_only=False)
            rare = np.flatnonzero(place < 0)
            own, own_ids = merges.of(flat.dictionary.take(pa.array(rare)))
            first, size = firsts[place].astype(np.int64), (firsts[place + 1] - firsts[place]).astype(np.int64)
            first[rare], size[rare] = own[:-1] + len(ids_of), np.diff(own)
            known = np.concatenate([ids_of, own_ids])
            pieces = flat.indices.to_numpy()
            doc_ids = table.column("doc_id").combine_chunks()
            ends = np.cumsum(counts, dtype=np.int64)
            a = 0
            while a < len(counts):
                base = ends[a] - counts[a]
                b = max(a + 1, int(np.searchsorted(ends, base + STEP, side="right")))
                mine = pieces[base : ends[b - 1]]
                sizes = size[mine]
                ids = known[spread(first[mine], sizes)]
                bounds = np.concatenate([[0], np.concatenate([[0], np.cumsum(sizes)])[ends[a:b] - base]])
                raw = ids.tobytes()
                id_list = [raw[4 * x : 4 * y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array(np.diff(bounds), pa.int64()), pa.array(id_list, pa.binary()), lists],
                    ["doc_id", "n_tokens", "ids", "list"],
                )
                a = b

    return run


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of a list of ids: their tokens' bytes, joined."""
    tokens = [""] * (1 + max(ranks.values(), default=-1))
    for token, rank in ranks.items():
        tokens[rank] = token.decode("latin-1")
    literal = F.from_json(F.lit(json.dumps(tokens)), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""), "ISO-8859-1")


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little-endian, one after the other) and
    decoded (UTF-8) for every row of ``docs``.

    Needs doc_id and text; other columns are ignored. A null or empty text has no
    ids. Repeated rows are encoded each time; an empty table gives an empty
    result. Every byte must have a rank. The pattern is matched with Unicode
    classes. A piece of n bytes takes up to n merges, n log n steps in all; it is
    held whole by one task.
    """
    pieces = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0)).alias("pieces"),
    )
    send = docs.sparkSession.sparkContext.broadcast
    sent = send(Merges(ranks))
    head = send(head_of(pieces, sent))
    found = pieces.mapInArrow(encoded(sent, head), "doc_id long, n_tokens long, ids binary, list array<int>")
    return found.select("doc_id", "n_tokens", "ids", decoded(F.col("list"), ranks).alias("decoded"))


def smaller_batches(spark) -> None:
    """Hundreds of pieces stand in each row sent to Python; these settings of the session
    keep a batch of them to a few megabytes. Results do not depend on them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scriptledger.llm.shared import documents

    smaller_batches(spark)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = encode_and_decode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

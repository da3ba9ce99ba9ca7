"""Removal of word windows seen in an earlier document, behind a count-min prefilter.

Three passes over the texts. The first counts windows in count-min sketches, one
per chunk of a partition; merged they never estimate too little, so a window
estimated once is unique. The second groups exactly the windows estimated
repeated, by 95 bits of hash: first within the chunk, which settles most copies,
then the windows of the chunk's first document in a shuffle. The third removes the words of
windows that start in a document with a smaller id.

The merged sketch has ``CELLS_PER_WINDOW`` cells per window and row, up to
``MAX_CELLS`` in all (one bit each once merged, 128 MB), which bounds what is
broadcast. Beyond that it lets more unique windows through; none is ever lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scriptledger.llm.bitmaps import collect_bitmap
from scriptledger.llm.shared import Words, chunks, mix, signed, window_hashes, window_starts

WINDOW = 13
ROWS = 2
CELLS_PER_WINDOW = 4
MAX_CELLS = 1 << 30
#: Cells of a segment, the unit in which sketches are merged.
SEGMENT = 1 << 18
#: Bytes of text of one chunk's sketch: the more, the closer its cells and the smaller their gaps.
SKETCH_BYTES = 4 << 20
#: Bytes of text in which copies are settled without a shuffle; a task holds some thirty times as many.
LOCAL_BYTES = 4 << 20
LAST_ID = (1 << 63) - 1


def first_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash per window, its first word's number and its text's number."""
    starts, owner = window_starts(words.offsets, k)
    return window_hashes(words.hashes(0), k)[starts], starts, owner


def cells(first: np.ndarray, row: int, width: int) -> np.ndarray:
    """The window's cell in a row of the sketch."""
    spread = mix(first + np.uint64(row) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (spread * np.uint64(width)) >> np.uint64(32)


def gaps(sorted_cells: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte by byte, which compresses well."""
    return np.diff(sorted_cells, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def ungaps(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64)


def sketch_chunks(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=SKETCH_BYTES):
            first, *_ = first_hashes(Words(batch.column("text")), k)
            if not len(first):
                continue
            segments, ones, twos = [], [], []
            for row in range(ROWS):
                found = np.sort(cells(first, row, width)).astype(np.int64)
                new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                often = np.diff(new, append=len(found)) > 1
                found = found[new]
                cuts = np.searchsorted(found, np.arange(0, width + SEGMENT, SEGMENT))
                for s in range(len(cuts) - 1):
                    a, b = cuts[s], cuts[s + 1]
                    if a < b:
                        segments.append(row * (-(-width // SEGMENT)) + s)
                        ones.append(gaps(found[a:b][~often[a:b]] - s * SEGMENT))
                        twos.append(gaps(found[a:b][often[a:b]] - s * SEGMENT))
            yield pa.RecordBatch.from_arrays(
                [pa.array(segments, pa.int32()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())],
                ["segment", "once", "twice"],
            )

    return run


def merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the counts of a segment's cells, up to two; a bit per cell: repeated."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = counts.setdefault(segment, np.zeros(SEGMENT, np.uint8))
            at = ungaps(once)
            held[at] = np.minimum(held[at] + 1, 2)
            held[ungaps(twice)] = 2
    for segment, held in counts.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([segment], pa.int32()), pa.array([np.packbits(held > 1).tobytes()], pa.binary())], ["segment", "bits"]
        )


def repeated_windows(k: int, width: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, per_row = np.frombuffer(zlib.decompress(sketch.value), np.uint8), -(-width // SEGMENT) * SEGMENT
        for batch in chunks(batches, limit=LOCAL_BYTES):
            words = Words(batch.column("text"))
            first, starts, owner = first_hashes(words, k)
            maybe = np.ones(len(first), bool)
            for row in range(ROWS):
                at = cells(first, row, width).astype(np.int64)
                at += row * per_row
                maybe &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            first, starts, owner = first[maybe], starts[maybe], owner[maybe]
            if not len(first):
                continue
            # The other half of the hash, for what is left.
            second = (window_hashes(words.hashes(1), k)[starts] >> np.uint64(33)).astype(np.int32)
            place = starts - words.offsets[:-1][owner]
            ids = pc.fill_null(batch.column("doc_id"), LAST_ID).to_numpy()
            crc = batch.column("crc").to_numpy()
            doc, spot = ids[owner], (crc[owner] << 32) | place
            order = np.lexsort((spot, doc, second, first))
            a, b, by_window = first[order], second[order], doc[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            early = np.empty(len(order), bool)
            early[order] = by_window == by_window[new][np.cumsum(new) - 1]  # in the chunk's first document with that window
            # In the order of texts: rows of a text next to each other take less of the shuffle.
            yield pa.RecordBatch.from_arrays(
                [signed(first[early]), pa.array(second[early]), pa.array(doc[early]), pa.array(spot[early]), pa.nulls(int(early.sum()), pa.binary())],
                WINDOW_COLUMNS,
            )
            # The others are known to come later: a row per text, alone in its group.
            late = np.flatnonzero(~early)
            if len(late):
                late = late[np.lexsort((spot[late], doc[late]))]
                own, text = doc[late], spot[late] >> 32
                cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
                offsets = np.append(cut, len(late)).astype(np.int32) * 8
                packed = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(spot[late].tobytes())])
                alone = mix(cut.astype(np.uint64) + first[0])
                yield pa.RecordBatch.from_arrays(
                    [signed(alone), pa.array(np.full(len(cut), -1, np.int32)), pa.array(doc[late][cut]), pa.nulls(len(cut), pa.int64()), packed],
                    WINDOW_COLUMNS,
                )

    return run


WINDOW_COLUMNS = ["first", "second", "doc", "spot", "spots"]


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts made smaller for their shuffle."""
    for batch in batches:
        small = [zlib.compress((text or "").encode(), 6) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("crc"), pa.array(small, pa.binary())], ["doc_id", "crc", "zipped"])


def keep_words(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for small, crc, one, many in zip(*(batch.column(c).to_pylist() for c in ("zipped", "crc", "spot", "spots")), strict=True):
                parts = zlib.decompress(small).split()
                gone = np.zeros(len(parts) + 1, np.int64)
                for found in [np.array(one or [], np.int64), *(np.frombuffer(x, np.int64) for x in many or [])]:
                    # Places in this text, not in another of the same doc_id.
                    mine = found[(found >> 32) & 0xFFFFFFFF == crc] & 0xFFFFFFFF
                    np.add.at(gone, mine, 1)
                    np.add.at(gone, mine + k, -1)
                removed = np.cumsum(gone)[:-1] > 0
                kept = [w for w, r in zip(parts, removed, strict=True) if not r] if removed.any() else parts
                out.append((len(parts), int(removed.sum()), b" ".join(kept).decode()))
            counts, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeated_windows(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) per row of ``docs``.

    Needs doc_id and text; other columns are ignored. A null or empty text has no
    words and keeps ''. Fewer than ``k`` words make no window. A null doc_id
    counts as larger than any other. Rows with one doc_id are one document: none
    of them is smaller than another. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    read = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    # Words are about six bytes; this only sizes the sketch.
    total = read.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    width = int(min(MAX_CELLS // ROWS, max(SEGMENT, CELLS_PER_WINDOW * total // 6)))
    per_row = -(-width // SEGMENT)
    merged = (
        read.select("text")
        .mapInArrow(sketch_chunks(k, width), "segment int, once binary, twice binary")
        .repartition("segment")
        .mapInArrow(merge_sketches, "segment int, bits binary")
    )
    # Few bits are set: compressed it is a fraction of its size on every machine.
    whole = collect_bitmap(merged, ROWS * per_row, SEGMENT // 8)
    sketch = spark.sparkContext.broadcast(zlib.compress(whole, 1))
    window = Window.partitionBy("first", "second")
    later = (
        read.mapInArrow(repeated_windows(k, width, sketch), "first long, second int, doc long, spot long, spots binary")
        .withColumn("least", F.min("doc").over(window))
        .where((F.col("second") == -1) | (F.col("least") < F.col("doc")))
        .groupBy("doc")
        .agg(F.collect_list("spot").alias("spot"), F.collect_list("spots").alias("spots"))
    )
    return (
        read.mapInArrow(zipped, "doc_id long, crc long, zipped binary")
        .withColumn("doc", F.coalesce("doc_id", F.lit(LAST_ID)))
        .join(later, "doc", "left")
        .select("doc_id", "zipped", "crc", "spot", "spots")
        .mapInArrow(keep_words(k), "doc_id long, n_words long, n_removed long, kept string")
    )


def query(spark, sf_dir: str) -> DataFrame:
    from scriptledger.llm.shared import documents

    kept = remove_repeated_windows(documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), placed AS (
  SELECT doc_id, ws, unnest(range(greatest(len(ws) - 12, 0))) AS p FROM split
), keyed AS (
  SELECT doc_id, p, array_to_string(ws[p + 1 : p + 13], ' ') AS w FROM placed
), least AS (
  SELECT w, min(doc_id) AS m FROM keyed GROUP BY w
), later AS (
  SELECT DISTINCT k.doc_id, unnest(range(k.p, k.p + 13)) AS q FROM keyed k JOIN least l USING (w) WHERE l.m < k.doc_id
), each AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS q FROM split
), kept AS (
  SELECT e.doc_id, string_agg(e.w, ' ' ORDER BY e.q) AS t, count(*) AS n
  FROM each e LEFT JOIN later l ON l.doc_id = e.doc_id AND l.q = e.q WHERE l.q IS NULL GROUP BY e.doc_id
)
SELECT s.doc_id, len(s.ws)::BIGINT AS n_words, (len(s.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""

"""Tables in the shared folder, and words of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from scriptledger.sources.scratch import discard as discard
from scriptledger.sources.scratch import durable as durable
from scriptledger.sources.scratch import shared_folder as shared_folder

#: ASCII white space separates words, here and in ``bytes.split``.
WORD = r"[^\x20\x09-\x0D]+"


class Words:
    """The words of an Arrow column of texts, as places in its bytes: ``data``,
    ``starts`` and ``ends`` of words, and ``offsets``, the first word of each text
    (one more than texts). Null texts have none."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        _, places, raw = texts.buffers()
        bounds = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(raw or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        white = np.zeros(256, bool)
        white[[0x20, *range(0x09, 0x0E)]] = True
        inside = ~white[data]
        # A word starts after white space or where a text does, and ends likewise.
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
        self.data, self.starts, self.ends = data, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word: the sum of a random number per byte value times a
        power of an odd number per place, mixed with the length. ``lower`` folds A-Z only."""
        draw = np.random.Generator(np.random.PCG64(1000 + seed))
        table = draw.integers(0, 1 << 64, 256, np.uint64)
        if lower:
            table[65:91] = table[97:123]
        base = int(draw.integers(0, 1 << 61, dtype=np.uint64)) * 8 + 5
        out = np.empty(len(self), np.uint64)
        power = inverse = np.ones(0, np.uint64)
        a = 0
        while a < len(out):
            low = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, low + HASH_BLOCK, side="right")))
            high = self.ends[b - 1]
            if high - low > len(power):
                both = base, pow(base, -1, 1 << 64)
                power, inverse = (block_powers(x) if high - low <= HASH_BLOCK else powers(x, high - low) for x in both)
            sums = table[self.data[low:high]]
            sums *= power[: high - low]
            np.cumsum(sums, out=sums)
            start = self.starts[a:b] - low
            value = sums[self.ends[a:b] - low - 1]
            value[1:] -= sums[start[1:] - 1]
            out[a:b] = value * inverse[start]
            a = b
        return mix(out + (self.ends - self.starts).astype(np.uint64))


#: Bytes whose hashes are summed at a time.
HASH_BLOCK = 1 << 20


@lru_cache(maxsize=4)
def block_powers(base: int) -> np.ndarray:
    """Of a block, computed once a process; read only."""
    return powers(base, HASH_BLOCK)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (Murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` made ``x`` of."""
    for factor in (0xC4CEB9FE1A85EC53, 0xFF51AFD7ED558CCD):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(pow(factor, -1, 1 << 64))
    return x ^ (x >> np.uint64(33))


def uncombine(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The second hash of ``combine``, of its result and the first one."""
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    x = x * np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
    first = a * np.uint64(0x9E3779B97F4A7C15)
    return x - (first ^ (first >> np.uint64(32)))


def window_hashes(hashed: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``k`` word hashes, put together from runs
    of 1, 2, 4, ... words."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, power, size, left = None, 0, hashed, 1, k
    while left:
        if left & 1:
            piece = power[at : at + n]
            out = piece if out is None else combine(out, piece)
            at += size
        left >>= 1
        if left:
            power = combine(power[:-size], power[size:])
            size *= 2
    return mix(out)


def window_starts(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the batch's runs of ``k`` words lie within one text, and that text."""
    sizes = np.maximum(np.diff(offsets) - k + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(len(owner)) - first[owner] + offsets[:-1][owner], owner


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined up to ``limit`` bytes of text (a longer text stands alone),
    and larger ones cut: the memory of a task depends neither on the length of
    its partition nor on the session's batch size."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield joined(held)
                held, size, start = [], 0, i
            size += int(n)
        if start < len(lengths):
            held.append(batch.slice(start))
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""Document fingerprints of improbable features in chained Bloom filters.

Every window of ``WINDOW`` bytes has an entropy. How often each (rounded) entropy
occurs over all documents ranks windows by rarity, rarest first. Wherever a window
is the rarest of at least ``POPULAR`` of the runs of ``RUN`` windows around it, it
is a feature. A feature's hash sets ``HASHES`` bits of a Bloom filter; a filter is
full after ``CAPACITY`` features and the next one is chained to it. Likeness is
the overlap of set bits above chance over the greatest possible, for each filter
of the shorter chain with its best partner, averaged.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptledger.llm.shared import chunks, mix, powers

WINDOW = 64
RUN = 64
POPULAR = 16
HASHES = 5
FILTER_BITS = 2048
CAPACITY = 160
#: Steps of rounded entropy.
LEVELS = 1000
#: Bytes whose windows are ranked together.
BLOCK = 1 << 20
#: Recurrences of a byte within a window that are counted for all places at once.
DENSE = 10
#: Bytes of text of a bucket of the document order, about, and how many there are at most.
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 8192
LEAST_ID = -(1 << 63)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Rounded entropy (0 to LEVELS) of each window of ``data``.

    The sum of c log c over a window's byte counts changes, as it slides, by what
    the entering byte adds and the leaving byte takes; both depend on how often
    that byte stands within a window's reach before or behind it.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    scale = 1 << 20
    c = np.arange(1, WINDOW + 1, dtype=np.float64)
    whole = np.concatenate([[0], np.round(scale * c * np.log2(c))]).astype(np.int64)
    gain = np.diff(whole, prepend=0)
    # Places grouped by byte value; equal bytes less than a window apart are counted.
    order = np.argsort(data, kind="stable")
    kind = np.uint32 if 256 * (n + WINDOW) < 1 << 32 else np.uint64
    key = order.astype(kind) + data[order] * kind(n + WINDOW)
    before, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    active = None
    for k in range(1, WINDOW):
        if active is None:
            near = key[k:] - key[:-k] < WINDOW
            before[k:] += near
            behind[:-k] += near
            if k == DENSE:
                active = np.flatnonzero(near) + k
        else:  # few bytes recur this often
            active = active[active >= k]
            active = active[key[active] - key[active - k] < WINDOW]
            if not len(active):
                break
            before[active] += 1
            behind[active - k] += 1
    enters, leaves = np.empty(n, np.int64), np.empty(n, np.int64)
    enters[order], leaves[order] = gain[before], gain[behind]
    sums = np.cumsum(np.concatenate([[enters[:WINDOW].sum()], enters[WINDOW:] - leaves[: n - WINDOW]]))
    top = whole[WINDOW]
    return np.maximum(top - sums, 0) * LEVELS // top


def blocks(raw: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for one in raw:
        if held and size + len(one) > BLOCK:
            yield held
            held, size = [], 0
        held.append(one)
        size += len(one)
    if held:
        yield held


def entropy_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS + 1, np.int64)
    for batch in chunks(batches):
        for part in blocks([(t or "").encode() for t in batch.column("text").to_pylist()]):
            sizes = np.array([len(x) for x in part])
            level = entropy_levels(np.frombuffer(b"".join(part), np.uint8))
            # Windows that start in one text and end in another are none.
            ends = np.repeat(np.cumsum(sizes), sizes)[: len(level)]
            total += np.bincount(level[np.arange(len(level)) + WINDOW <= ends], minlength=LEVELS + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1)), pa.array(total)], ["level", "windows"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level, 0 the rarest over all texts, ties to the lower level."""
    found = (
        docs.select("text").mapInArrow(entropy_counts, "level long, windows long").groupBy("level").agg(F.sum("windows").alias("n")).toArrow()
    )
    counts = np.zeros(LEVELS + 1, np.int64)
    counts[found.column("level").to_numpy()] = found.column("n").to_numpy()
    rank = np.empty(LEVELS + 1, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(LEVELS + 1)
    return rank


def features(part: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the selected windows in order of text and place. A text shorter
    than a window is one feature, an empty one has none."""
    padded = [x if len(x) >= WINDOW or not x else x.ljust(WINDOW, b"\0") for x in part]
    sizes = np.array([len(x) for x in padded], np.int64)
    data = np.frombuffer(b"".join(padded), np.uint8)
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    level = entropy_levels(data)
    places = np.arange(len(level))
    last = ends[owner[: len(level)]]  # end of each window's text
    worst = (LEVELS + 2) << 40
    value = np.where(places + WINDOW <= last, (rank[level] << 40) + places, worst)
    least, width = value, 1
    while width < RUN:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    # Runs inside one text: the last window of the run ends in it, too.
    starts = np.flatnonzero(places[: len(least)] + RUN - 1 + WINDOW <= last[: len(least)])
    popular = np.bincount(least[starts] & ((1 << 40) - 1), minlength=len(level))
    chosen = popular >= POPULAR
    some = sizes > 0
    first = (ends - sizes)[some]
    best = np.minimum.reduceat(value, first) & ((1 << 40) - 1)
    chosen[best] = True  # every text has its rarest window
    at = np.flatnonzero(chosen)
    # Hash of the window's bytes: a random number per byte value times a power per place.
    draw = np.random.Generator(np.random.PCG64(64))
    table = draw.integers(0, 1 << 64, 256, np.uint64)
    base = int(draw.integers(0, 1 << 61, dtype=np.uint64)) * 8 + 5
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * powers(base, n))])
    hashed = mix((sums[at + WINDOW] - sums[at]) * powers(pow(base, -1, 1 << 64), n)[at])
    return owner[at], hashed


def bloom_chains(texts: list[str], rank: np.ndarray) -> list[tuple[bytes, ...]]:
    """The filters of each text."""
    found: list[tuple[bytes, ...]] = []
    for part in blocks([t.encode() for t in texts]):
        owner, hashed = features(part, rank)
        # A feature that a text repeats counts once, where it comes first.
        _, keep = np.unique(np.stack([owner.astype(np.uint64), hashed]), axis=1, return_index=True) if len(owner) else (None, np.zeros(0, int))
        keep.sort()
        owner, hashed = owner[keep], hashed[keep]
        counts = np.bincount(owner, minlength=len(part))
        filters = -(-counts // CAPACITY)
        first = np.cumsum(filters) - filters
        place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        mine = (first[owner] + place // CAPACITY) * FILTER_BITS
        bits = np.zeros(int(filters.sum()) * FILTER_BITS, bool)
        for i in range(HASHES):
            bits[mine + ((hashed >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        packed, size = np.packbits(bits).tobytes(), FILTER_BITS // 8
        found += [tuple(packed[size * j : size * (j + 1)] for j in range(f, f + k)) for f, k in zip(first, filters, strict=True)]
    return found


def likeness(left: tuple[bytes, ...], right: tuple[bytes, ...]) -> float:
    if not left or not right:
        return float(left == right)
    if len(left) > len(right) or (len(left) == len(right) and left > right):
        left, right = right, left
    others = [int.from_bytes(x) for x in right]
    total = 0.0
    for one in left:
        one = int.from_bytes(one)
        a, best = one.bit_count(), 0.0
        for other in others:
            b = other.bit_count()
            chance, most = a * b / FILTER_BITS, min(a, b)
            if most > chance:
                best = max(best, ((one & other).bit_count() - chance) / (most - chance))
            elif one == other:
                best = 1.0
        total += best
    return min(1.0, total / len(left))


def as_text(chain: tuple[bytes, ...]) -> str:
    return base64.b64encode(b"".join(chain)).decode()


def bucket_of(order: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Buckets in descending order of ids."""
    return len(bounds) - np.searchsorted(bounds, order, side="left")


def bucketed_ids(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column("order").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(order, bounds)), batch.column("order"), batch.column("tie")], ["bucket", "order", "tie"])

    return run


def dealt(bounds: np.ndarray, guests: dict[tuple[int, int], list[int]]):
    """Each row to its bucket; the first row of a bucket also, as a guest, to the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, tie = batch.column("order").to_numpy(), batch.column("tie").to_numpy()
            own = bucket_of(order, bounds)
            take, bucket, guest = list(range(len(order))), own.tolist(), [False] * len(order)
            for i, key in enumerate(zip(order.tolist(), tie.tolist(), strict=True)):
                for b in guests.get(key, ()):
                    take.append(i)
                    bucket.append(b)
                    guest.append(True)
            moved = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(guest), *moved.columns], ["bucket", "guest", *moved.schema.names])

    return run


def edited_text(text: str, follower: str) -> str:
    """The last third of the code points replaced by as many first ones of the follower."""
    n = len(text) // 3
    return text[: len(text) - n] + follower[:n]


def fingerprinted(sent):
    """Rows of a bucket follow each other in document order, so each meets its next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        rank = sent.value
        carried: list[tuple] = []
        for batch in chunks(batches, limit=4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = carried + list(
                zip(batch.column("bucket").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), texts, bloom_chains(texts, rank), strict=True)
            )
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
            carried = rows[-1:]
            edits = [edited_text(a[3], b[3]) for a, b in pairs]
            chains = bloom_chains(edits, rank)
            out = [
                (a[2], len(a[3]), hashlib.sha256(e.encode()).hexdigest(), e, as_text(a[4]), as_text(c), likeness(a[4], c), likeness(a[4], b[4]))
                for (a, b), e, c in zip(pairs, edits, chains, strict=True)
            ]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)

    return run


NAMES = ["doc_id", "n_chars", "edited_sha256", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: doc_id, n_chars, edited_text and its SHA-256, the
    fingerprints of the text and of the edited text, and the likeness of the text's
    to the edited text's and to the next document's. Documents follow each other in
    descending doc_id, the first after the last; a lone row follows itself.

    Needs doc_id and text; other columns are ignored. A null text is empty. An empty
    text has the empty fingerprint, which is like another such (1) and nothing else
    (0). A null doc_id stands below all others. Rows of one doc_id are ordered by a
    hash of the text; equal rows stand in any order, which changes nothing. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("order"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
    )
    total = read.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    count = min(MAX_BUCKETS, max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    at = [i / count for i in range(1, count)]
    found = read.select(F.percentile_approx("order", at, 10 * count).alias("q")).first()["q"] if at else []
    bounds = np.unique(np.array(found or [], np.int64))
    # The first row of each bucket: a row per bucket.
    heads = (
        read.select("order", "tie").mapInArrow(bucketed_ids(bounds), "bucket long, order long, tie long")
        .groupBy("bucket")
        .agg(F.min(F.struct(F.bitwise_not("order").alias("down"), "tie", "order")).alias("head"))
        .orderBy("bucket")
        .collect()
    )
    guests: dict[tuple[int, int], list[int]] = {}
    for i, row in enumerate(heads):
        follower = heads[(i + 1) % len(heads)]["head"]
        guests.setdefault((follower["order"], follower["tie"]), []).append(row["bucket"])
    rows = (
        read.mapInArrow(dealt(bounds, guests), "bucket long, guest boolean, doc_id long, text string, order long, tie long")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "guest", F.col("order").desc(), "tie")
        .select("bucket", "guest", "doc_id", "text")
    )
    schema = "doc_id long, n_chars long, edited_sha256 string, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(fingerprinted(spark.sparkContext.broadcast(rarity(docs))), schema)


def query(spark, sf_dir: str) -> DataFrame:
    from scriptledger.llm.shared import documents

    return fingerprint_neighbours(documents(spark, sf_dir)).drop("edited_text")

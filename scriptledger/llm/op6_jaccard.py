"""N-gram Jaccard join by parity sketches, and the components of its links.

Texts with one shingle set form a class. A class's sketch has K words of bits;
each shingle's hash toggles one bit of one word, so the Hamming distance of two
sketches never exceeds the symmetric difference of their sets. Sets of sizes a
and b that reach similarity p/100 differ in at most (a+b)(100-p)/(100+p)
shingles. Classes are split into size bands; in a band of K words, two linked
classes whose partners' bounds are d agree in at least 1 + e of their first
d + 1 + e words (pigeonhole), so joining on (band, place, word) finds every link.
Words of few bits are often equal by chance, or by one phrase that many texts
share. A class leaves out its words of up to m bits, m the largest number up to
WEAK for which these are at most e: of the 1 + e words two linked classes agree
in, one has more bits than either leaves out.

Candidates are verified with exact set sizes. Components need no pair inside one
already linked group: first each class is verified against one class, the first
of its buckets; then the pairs of a bucket that still lie in different components
are compared. Those are many where near copies stay just below the similarity, so
no pair becomes a row: blocks of bounded size are compared within tasks, first by
the Hamming distance of one more parity sketch, bucket by bucket, then, for the
classes this cannot rule out, by whole sets, which go to the groups that may be
linked and are sent once for each block they meet. Tasks return a spanning forest
of the components they join, no more rows than they read. That sketch has at least
a bit per shingle: a distance never exceeds half the bits, and the difference that
linked sets may have grows with them, so fewer bits would rule out no large sets.
Whole sets are made only of the classes that sketches leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptledger.llm.components import connected
from scriptledger.llm.shared import Words, chunks, discard, durable, joined, mix, signed, window_hashes

#: Words beyond d + 1, which let classes leave out their weak words: at least so many,
#: and a share of d that a similarity of at least so many hundredths pays for.
SPARE = 2
SPARE_SHARES = ((85, 0.3), (78, 0.15), (0, 0.03))
#: Most set bits of a word that counts as weak.
WEAK = 2
#: Upper ends of size bands grow by this factor.
BAND = 1.5
GOLDEN = 0x9E3779B97F4A7C15
#: Least bits of the sketch by which the classes of a bucket are compared.
SKETCH_BITS = 1024
#: Rows of a bucket up to which buckets are first compared many at a time, and bytes of sketches then.
SMALL_BUCKET, PAIR_BYTES = 32, 16 << 20
#: Classes of a block of such comparisons, and bytes of sets of a block, a longer set alone.
BLOCK = 1024
BLOCK_BYTES = 16 << 20
#: Bytes of a shingle in a packed set.
SET_BYTES = 6
#: Bits of a sketch's word: so many that two sets of a few shingles hardly meet by chance.
WORD_BITS = 1 << 16


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending. Fewer than ``k`` words
    are one shingle; no words are none."""
    words = Words(texts)
    offsets, hashed = words.offsets, words.hashes(lower=True)
    every = window_hashes(hashed, k)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield window_hashes(hashed[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def class_of(found: np.ndarray) -> int:
    """64 bits that tell sets apart; -1 is kept for empty sets."""
    total = int(mix(found).sum(dtype=np.uint64)) ^ (len(found) * GOLDEN & (1 << 64) - 1)
    value = int(mix(np.array([total], np.uint64)).view(np.int64)[0])
    return value if value != -1 else -2


def most_different(a: int, b: int, percent: int) -> int:
    return (a + b) * (100 - percent) // (100 + percent)


def partner_bound(a: int, percent: int) -> int:
    """Largest symmetric difference that a set of size ``a`` may have with a partner."""
    return most_different(a, 100 * a // percent, percent)


def band_ends(size: int) -> list[int]:
    """Exclusive upper ends of the bands up to the one that holds ``size``."""
    ends = [2]
    while ends[-1] <= size:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND)))
    return ends


def spare(d: int, percent: int) -> int:
    return SPARE + int(d * next(share for least, share in SPARE_SHARES if percent >= least))


def bands_of(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, K, e) for the band of a set and, where a partner may lie there, the next one."""
    ends = band_ends(100 * size // percent)
    own = int(np.searchsorted(ends, size, side="right"))
    last = int(np.searchsorted(ends, 100 * size // percent, side="right"))
    found = []
    for band in range(own, last + 1):
        d = partner_bound(ends[band] - 1, percent)
        found.append((band, d + 1 + spare(d, percent), spare(d, percent)))
    return found


def sketch(found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketch's ``k`` words of WORD_BITS bits, each as the exclusive or of a
    64-bit hash per bit that is set (0 without any), and how many are set."""
    spread = mix(found ^ np.uint64(GOLDEN))
    place = ((spread >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    at, times = np.unique(place * np.uint64(WORD_BITS) + (spread & np.uint64(WORD_BITS - 1)), return_counts=True)
    at = at[times % 2 == 1]
    place = (at // np.uint64(WORD_BITS)).astype(np.int64)
    word = np.zeros(k, np.uint64)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        word[place[first]] = np.bitwise_xor.reduceat(mix(at + np.uint64(GOLDEN)), first)
    return word, np.bincount(place, minlength=k)


def join_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """Keys under which a set meets every set it may link with."""
    keys = []
    for band, k, e in bands_of(len(found), percent):
        n = min(k, partner_bound(len(found), percent) + 1 + e)
        word, bits = sketch(found, k)
        word, bits = word[:n], bits[:n]
        weak = max((m for m in range(WEAK + 1) if (bits <= m).sum() <= e), default=-1)
        place = np.arange(n, dtype=np.uint64) | np.uint64(band << 40)
        kept = bits > weak
        keys.append(mix(word[kept] ^ mix(place[kept] + np.uint64(GOLDEN))))
    return np.concatenate(keys)


def describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = list(shingle_sets(batch.column("text"), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) if len(s) else -1 for s in sets], pa.int64()),
                ],
                ["doc_id", "n_shingles", "node"],
            )

    return run


def keyed(k: int, percent: int):
    """Keys of each class, once per chunk however many copies it has, its sketch beside the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            seen, keys, nodes, sizes, sketched = set(), [], [], [], []
            for found in shingle_sets(batch.column("text"), k):
                node = class_of(found)
                if len(found) and node not in seen:
                    seen.add(node)
                    # A set too small to differ from a partner links with its copies only.
                    if partner_bound(len(found), percent):
                        keys.append(join_keys(found, percent))
                        nodes.append(node)
                        sizes.append(len(found))
                        if len(keys[-1]):
                            sketched += [parities(found), *[None] * (len(keys[-1]) - 1)]
            if keys:
                each = [len(x) for x in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(np.concatenate(keys)),
                        pa.array(np.repeat(np.array(nodes, np.int64), each)),
                        pa.array(np.repeat(np.array(sizes, np.int32), each)),
                        pa.array(sketched, pa.binary()),
                    ],
                    ["key", "node", "n", "sketch"],
                )

    return run


def packed_sets(k: int, wanted):
    """Whole sets of the classes a bitmap of their numbers lets through, once per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in chunks(batches):
            seen, out = set(), []
            for found in shingle_sets(batch.column("text"), k):
                node = class_of(found) if len(found) else -1
                at = node_bit(node, len(bits))
                if node != -1 and node not in seen and bits[at >> 3] >> (7 - (at & 7)) & 1:
                    seen.add(node)
                    out.append((node, packed(found)))
            if out:
                nodes, sets = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


#: Bits of the filter that keeps sets of unlinked classes out of tables and shuffles (8 MB).
FILTER_BITS = 1 << 26
FILTER_SEGMENT = 1 << 20
#: Pairs up to which they are broadcast to the sets; more are joined by shuffle.
BROADCAST_PAIRS = 1 << 21


def packed(found: np.ndarray) -> bytes:
    """A set's hashes cut to 48 bits: two hashes of one pair of sets fall together about once in 10^9 pairs."""
    return found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return np.sort(wide.view("<u8").ravel())


def node_bit(node: int, size: int) -> int:
    return node & (8 * size - 1)


def filter_of(nodes: DataFrame) -> np.ndarray:
    """A bit for each node, by its low bits: fixed in size, and only ever passes too many."""
    from scriptledger.llm.bitmaps import collect_bitmap

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("bit").to_numpy()
            for segment in np.unique(at // FILTER_SEGMENT):
                mine = at[at // FILTER_SEGMENT == segment] % FILTER_SEGMENT
                held.setdefault(int(segment), np.zeros(FILTER_SEGMENT, bool))[mine] = True
        for segment, bits in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["segment", "bits"]
            )

    bit = F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1))
    packed = nodes.select(bit.alias("bit")).distinct().repartition(F.expr(f"bit div {FILTER_SEGMENT}")).mapInArrow(pack, "segment int, bits binary")
    return collect_bitmap(packed, FILTER_BITS // FILTER_SEGMENT, FILTER_SEGMENT // 8)


def similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, seen = [], {}
            for b, left, right in zip(*(batch.column(c).to_pylist() for c in ("b", "left", "right")), strict=True):
                if b not in seen:
                    seen = {b: unpacked(right)}  # rows come by b
                left, right = unpacked(left), seen[b]
                common = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    return run


def passing(bits, column: str):
    """Rows whose node a bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            at = batch.column(column).to_numpy() & (8 * len(held) - 1)
            yield batch.filter(pa.array((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) by the sizes of whole sets. ``b`` is the side that few nodes are on."""
    send = sets.sparkSession.sparkContext.broadcast
    schema = "node long, shingles binary"
    left, right = (
        sets.mapInArrow(passing(send(filter_of(pairs.select(F.col(side).alias("node")))), "node"), schema) for side in "ab"
    )
    small = pairs.count() <= BROADCAST_PAIRS
    left = left.join(F.broadcast(pairs) if small else pairs, left["node"] == pairs["a"]).select("a", "b", F.col("shingles").alias("left"))
    right = right.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return left.join(right, "b").mapInArrow(similar(percent), "a long, b long, linked boolean").distinct()


def parities(found: np.ndarray) -> bytes:
    """Sketch of a power of two of bits, at least one for each shingle. The xor of its halves is the one of half the bits."""
    size = max(SKETCH_BITS, 1 << (len(found) - 1).bit_length())
    at = (mix(found) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size).astype(np.uint8) & 1).tobytes()


class Sketches:
    """Sketches of several sizes, and their Hamming distances at the smaller size of each two."""

    def __init__(self, blobs: list[bytes]):
        self.words = np.array([len(x) // 8 for x in blobs], np.int64)
        self.rows, self.at = {}, np.zeros(len(blobs), np.int64)
        for size in np.unique(self.words).tolist():
            mine = np.flatnonzero(self.words == size)
            self.at[mine] = np.arange(len(mine))
            self.rows[size] = np.frombuffer(b"".join(blobs[i] for i in mine.tolist()), np.uint64).reshape(-1, size)

    def folded(self, rows: np.ndarray, size: int, to: int) -> np.ndarray:
        found = self.rows[size][self.at[rows]]
        while found.shape[1] > to:
            found = found[:, : found.shape[1] // 2] ^ found[:, found.shape[1] // 2 :]
        return found

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        kinds = self.words[i] * (1 << 31) + self.words[j]
        for kind in np.unique(kinds).tolist():
            a, b = kind >> 31, kind & (1 << 31) - 1
            mine = np.flatnonzero(kinds == kind)
            step = max(1, PAIR_BYTES // (8 * max(a, b)))
            for x in range(0, len(mine), step):
                part = mine[x : x + step]
                differ = self.folded(i[part], a, min(a, b)) ^ self.folded(j[part], b, min(a, b))
                out[part] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        return out


def not_ruled_out(n: np.ndarray, bits: Sketches, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be similar by sizes and sketches."""
    ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    i, j = i[ok], j[ok]
    ok[ok] = bits.far(i, j) <= (n[i] + n[j]) * (100 - percent) // (100 + percent)
    return ok


def close_rows(n: np.ndarray, bits: Sketches, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of ``left`` with the rows of ``right`` that sizes and sketches do not rule out."""
    for a in range(0, len(left), 128):
        one = left[a : a + 128]
        close = not_ruled_out(n, bits, np.repeat(one, len(right)), np.tile(right, len(one)), percent)
        for i, row in zip(one.tolist(), close.reshape(len(one), -1), strict=True):
            yield i, right[row]


def close_stars(percent: int):
    """Pairs that sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n", "m")]).astype(np.int64)
            bits = Sketches(batch.column("left").to_pylist() + batch.column("right").to_pylist())
            near = not_ruled_out(n, bits, np.arange(rows), np.arange(rows, 2 * rows), percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows cut where the first three columns change, and where such groups start."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else joined([held, batch])
        new = np.zeros(held.num_rows, bool)
        new[:1] = True
        for column in held.columns[:3]:
            values = column.to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts[:-1]
            held = held.slice(starts[-1])
    if held is not None:
        yield held, np.zeros(1, np.int64)


def bucket_links(percent: int, use):
    """``use`` on the rows of large buckets and of blocks. Small buckets, which most are, are compared
    many at a time and two classes once, however many buckets they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches):
            node, n, root = (rows.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "root"))
            sizes = np.diff(starts, append=rows.num_rows)
            small = sizes <= SMALL_BUCKET
            small &= rows.column("low").to_numpy()[starts] == rows.column("high").to_numpy()[starts]
            _, place, number = np.unique(node, return_index=True, return_inverse=True)
            pairs = [np.zeros(0, np.int64)]
            for size in np.unique(sizes[small]).tolist():
                first = starts[small & (sizes == size)][:, None]
                i, j = (number[first + x].ravel() for x in np.triu_indices(size, 1))
                pairs.append(np.unique(np.minimum(i, j) * len(place) + np.maximum(i, j)))
            i, j = (place[x] for x in np.divmod(np.unique(np.concatenate(pairs)), len(place)))
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            near = not_ruled_out(n, Sketches(rows.column("sketch").to_pylist()), i, j, percent) if len(i) else np.zeros(0, bool)
            i, j = i[near], j[near]
            found = list(may_link_rows(node, n, root, i, j))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), MAY_LINK.values(), strict=True)], list(MAY_LINK))
            if not small.all():
                yield from use(iter([rows.filter(pa.array(np.repeat(~small, sizes)))]))

    return run


def may_link_rows(node, n, root, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
    """may_link()'s rows of the pairs (i, j), as a spanning forest of their roots."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        one, other = top(int(root[a])), top(int(root[b]))
        if one != other:
            parent[one] = other
            yield int(node[a]), int(n[a]), int(root[a]), int(root[b])
    for a in np.unique(np.concatenate([i, j])).tolist():
        yield int(node[a]), int(n[a]), int(root[a]), int(root[a])


MAY_LINK = {"node": pa.int64(), "n": pa.int32(), "root": pa.int64(), "other": pa.int64()}


def grouped_blocks(use, names: list[str], types: list[pa.DataType]):
    """``use(columns)`` on the rows of each two blocks, which come sorted by the first three
    columns (group, low, high). Its rows, of distinct values, are what is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            out = sorted(set(use(*zip(*held, strict=True))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield from flush()
                    held = []
                held.append(row)
        if held:
            yield from flush()

    return run


def may_link(percent: int):
    """(node, n, root, other) for classes of a bucket's two blocks that may be similar to one
    of another component. Pairs (root, other) that differ are a spanning forest of what may
    be linked, so there are at most two rows for a row read."""

    def use(key, low, high, own, node, n, root, sketch) -> Iterator[tuple]:
        size, blocks = np.array(n, np.int64), np.array(own)
        bits = Sketches(list(sketch))
        own_root = np.unique(np.array(root, np.int64), return_inverse=True)[1]
        label, open_ = own_root.copy(), np.zeros(len(node), bool)
        for i, js in close_rows(size, bits, np.flatnonzero(blocks == low[0]), np.flatnonzero(blocks == high[0]), percent):
            js = js[own_root[js] != own_root[i]]
            open_[js] = True
            open_[i] |= len(js) > 0
            for j in js[np.unique(label[js], return_index=True)[1]].tolist():
                if label[j] != label[i]:
                    yield node[i], n[i], root[i], root[j]
                    label[label == label[j]] = label[i]
        for i in np.flatnonzero(open_).tolist():
            yield node[i], n[i], root[i], root[i]

    return bucket_links(percent, grouped_blocks(use, list(MAY_LINK), list(MAY_LINK.values())))


def block_links(percent: int):
    """(a, b) for classes of two blocks whose whole sets are similar, as a spanning forest of
    the components they join: at most a row for each row read, whatever the pairs."""

    def use(group, low, high, own, node, root, shingles) -> Iterator[tuple]:
        sets = [unpacked(x) for x in shingles]
        blocks, size = np.array(own), np.array([len(x) for x in sets], np.int64)
        bits = Sketches([parities(x) for x in sets])
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        starts = ends - size
        label = np.unique(np.array(root, np.int64), return_inverse=True)[1]
        mine = np.zeros(len(known), np.int32)
        for i, js in close_rows(size, bits, np.flatnonzero(blocks == low[0]), np.flatnonzero(blocks == high[0]), percent):
            js = js[label[js] != label[i]]
            if not len(js):
                continue
            mine[flat[starts[i] : ends[i]]] = 1
            before = np.cumsum(size[js]) - size[js]
            places = np.repeat(starts[js] - before, size[js]) + np.arange(size[js].sum())
            common = np.add.reduceat(mine[flat[places]], before).astype(np.int64)
            mine[flat[starts[i] : ends[i]]] = 0
            js = js[100 * common >= percent * (size[i] + size[js] - common)]
            for j in js[np.unique(label[js], return_index=True)[1]].tolist():
                if label[j] != label[i]:
                    yield min(node[i], node[j]), max(node[i], node[j])
                    label[label == label[j]] = label[i]

    return grouped_blocks(use, ["a", "b"], [pa.int64(), pa.int64()])


def in_block_pairs(frame: DataFrame, group: str, *columns: str) -> DataFrame:
    """Rows of ``frame`` (node, blocks and more) once for each two blocks of their group."""
    return (
        frame.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("another", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(group, F.least("own", "another").alias("low"), F.greatest("own", "another").alias("high"), "own", *columns)
        .repartition(group, "low", "high")
        .sortWithinPartitions(group, "low", "high")
    )


def class_links(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of every class linked with another."""
    send = texts.sparkSession.sparkContext.broadcast
    every = durable(texts.mapInArrow(keyed(k, percent), "key long, node long, n int, sketch binary"), "op6-keys")
    shared = durable(
        every.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("key"), "op6-shared"
    )
    # Few keys are shared: the rest need not be shuffled again.
    bits = send(filter_of(shared.select(F.col("key").alias("node"))))
    few = every.drop("sketch").mapInArrow(passing(bits, "key"), "key long, node long, n int")
    members = durable(few.join(shared, "key").distinct(), "op6-members")
    bits = send(filter_of(members.select("node")))
    shapes = every.where("sketch IS NOT NULL").select("node", "n", "sketch").mapInArrow(passing(bits, "node"), "node long, n int, sketch binary")
    shapes = durable(shapes.dropDuplicates(["node"]), "op6-sketches")
    discard(every, shared)

    def whole_sets(nodes: DataFrame) -> DataFrame:
        return texts.mapInArrow(packed_sets(k, send(filter_of(nodes))), "node long, shingles binary")

    # Each class against the first class of its buckets that is not itself.
    first = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"))
    stars = members.join(first, "key").where(F.col("node") != F.col("first.node"))
    stars = near_in_size(stars, F.col("n"), F.col("first.n"), percent)
    stars = durable(stars.groupBy("node").agg(F.min("first.node").alias("b")).select(F.col("node").alias("a"), "b"), "op6-stars")
    stars = stars.join(shapes.select(F.col("node").alias("a"), "n", F.col("sketch").alias("left")), "a")
    stars = stars.join(shapes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("right")), "b")
    stars = durable(stars.mapInArrow(close_stars(percent), "a long, b long"), "op6-close")
    sets = durable(whole_sets(stars.select(F.col("a").alias("node")).unionAll(stars.select("b"))), "op6-sets")
    checked = durable(verified(stars, sets, percent), "op6-checked")
    links = checked.where("linked").select("a", "b")
    roots = connected(links)

    # Then, by sketches, which classes of different components may be linked.
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
    open_ = durable(
        placed.join(mixed.where("low <> high").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key"), "op6-open"
    )
    maybe = in_block_pairs(open_.join(shapes.select("node", "sketch"), "node"), "key", "node", "n", "root", "sketch").mapInArrow(
        may_link(percent), "node long, n int, root long, other long"
    )
    maybe = durable(maybe.distinct(), "op6-maybe")

    # Last, whole sets of what may be linked, a set once for each block it is compared with.
    groups = connected(maybe.select(F.col("root").alias("a"), F.col("other").alias("b"))).select(
        F.col("node").alias("root"), F.col("root").alias("group")
    )
    left = durable(maybe.select("node", "n", "root").distinct().join(groups, "root"), "op6-left")
    blocks = left.groupBy("group").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n").cast("long")) * SET_BYTES / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    whole = whole_sets(left.select("node")).dropDuplicates(["node"])
    more = in_block_pairs(left.join(blocks, "group").join(whole, "node"), "group", "node", "root", "shingles").mapInArrow(
        block_links(percent), "a long, b long"
    )
    return connected(links.unionAll(durable(more, "op6-more")))


def near_in_size(frame: DataFrame, a, b, percent: int) -> DataFrame:
    return frame.where(100 * F.least(a, b) >= percent * F.greatest(a, b))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Needs doc_id and text; other columns are ignored. A null, empty or blank text
    has no shingles and links with nothing, not even another such. Fewer than
    ``k`` words are one shingle. Equal sets link. component_id is the smallest
    doc_id of a component; rows that repeat a doc_id stay as they are, and a
    component without any doc_id has a null component_id. An empty table gives an
    empty result. Classes are told apart by 64-bit hashes of their sets.
    """
    texts = docs.select("text")
    info = durable(docs.select("doc_id", "text").mapInArrow(describe(k), "doc_id long, n_shingles long, node long"), "op6-documents")
    classes = info.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    roots = class_links(texts, k, percent)
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(rooted.join(least, "root").select("node", "component_id"), "op6-classes")
    return (
        info.join(named, "node", "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id")
    )


def query(spark, sf_dir: str) -> DataFrame:
    from scriptledger.llm.shared import documents

    return jaccard_components(documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long")), k=4, percent=85)


SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), placed AS (
  SELECT doc_id, ws, unnest(range(greatest(len(ws) - 3, least(len(ws), 1)))) AS p FROM split
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + 4], ' ') AS g FROM placed
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), reached(doc_id, r) AS (
  SELECT doc_id, doc_id FROM split UNION SELECT reached.doc_id, y FROM reached JOIN links ON x = r
)
SELECT s.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM split s JOIN reached USING (doc_id) LEFT JOIN sizes z USING (doc_id) GROUP BY s.doc_id, z.n
"""

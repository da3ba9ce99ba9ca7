"""Language-model scores from a probabilistic suffix tree over words.

States are runs of words (contexts). A context, or a pair of context and follower,
is a candidate if the training texts hold it ``LEAST`` times; a context is kept if
its followers diverge from those of its longest proper suffix by more than their
description costs, or if a longer kept context ends in it, so that the states are
closed under suffixes. A state's distribution discounts the counts of its frequent
followers and gives the rest of its mass to its suffix's distribution; the root is
the add-one distribution over all training words and one unknown word. A text is
scored by the longest state that is a suffix of what came before each token; before
the first word that is the end token.

The tree grows with the corpus, so it is never held in one place: grams and contexts
are tables, told apart by 64-bit hashes, and the divergence test is a grouped sum. A
token's log probability is a sum over tables, too: its root's, the share that each
state before it leaves to its suffix, and for each of these states that has seen the
token the gain over the suffix's part alone. So each gram has one value, and a text's
score is the sum of the values of its grams: the most frequent grams' are broadcast
(at most 1 / ``HEAD_MIN`` a length), the others are joined. Broadcast bitmaps leave
out grams that cannot be in a table; one too many costs a request and nothing else.

Tables are parcels of keys (``parcels``), written after each shuffle: grams meet by their
hash to be counted, by their suffix for its probability, by their context for the
divergence test, and last with the requests of texts. Words and pairs are counted
together. Values in tables are fixed-point numbers, units of 2^-41.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptledger.llm.bitmaps import collect_bitmap
from scriptledger.llm.parcels import (
    BYTES,
    HELD,
    PARCEL,
    UNITS,
    Parcels,
    content,
    dealt,
    fixed,
    grouped,
    meet,
    of_kind,
    packed,
    rows,
    run_starts,
    summed,
    taken,
    units,
)
from scriptledger.llm.shared import Words, chunks, combine, discard, durable, mix, uncombine, unmix

#: Times that a context, or a pair of context and follower, must occur to be in the tree.
LEAST = 2
#: Grams with at least this share of the tokens have their values broadcast.
HEAD_MIN = 2.0**-20
DEPTH = 3
DISCOUNT = 0.5
#: Bytes of text that a task works on at a time; its arrays take about 30 times as many.
TEXT_BYTES = 1 << 18
#: Texts or parcels that the JVM sends a task at a time, and the setting for it.
BATCH_ROWS, BATCH_SETTING = 50, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Hashes of the token before a text and of the one after it.
BEGIN, AFTER = np.uint64(0xB5E1A9C40D2F7731), np.uint64(0x5D1F03E86C9A42B7)
#: Bits of a bitmap for each gram in it, of a bitmap at most, and of a segment.
GRAM_BITS, MOST_BITS, SEGMENT_BITS = 8, 1 << 28, 1 << 20
#: What parcels hold. Bits of a part's number at least and at most, and bytes of text for a part between these.
WORD_COUNT, COUNT, WORD, GRAM, BELOW, ROW, TOTAL, FORCED, VALUE, HEAD, REQUEST, TOP, ANSWER = range(13)
LEAST_BITS, MOST_PART_BITS, PART_BYTES = 6, 16, 6 << 20
#: Texts of a source at most, whose places have two bytes; parts of the texts that are scored one after the other.
SOURCE_TEXTS, SLICES = 1 << 16, 3
#: For the tree on one machine: code of the end token, and the factor of codes in a gram's number.
END = 0
SHIFT = np.int64(1 << 23)


@contextmanager
def small_batches(spark: SparkSession):
    """For tables written meanwhile: a batch of whole texts takes several times its size in the JVM, and again in the worker."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


def is_training(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


def word_counts(batches: Iterator[pa.RecordBatch], bits: int = LEAST_BITS) -> Iterator[pa.RecordBatch]:
    """Words and pairs of words with their counts, the marks around texts among them; by
    64-bit hash. A pair that is frequent has frequent words, so it can be counted before they are known."""

    def found():
        for batch in chunks(batches, limit=TEXT_BYTES):
            (tokens,), _, place = gram_hashes(Words(batch.column("text")), 1)
            words, n = np.unique(tokens, return_counts=True)
            words_held.append((words, n))
            context = tokens[np.flatnonzero(place[1:] >= 1)]
            yield joined_hash(context, tokens[1:][place[1:] >= 1]), context

    def words_of(least: int) -> Iterator[pa.RecordBatch]:
        if sum(len(words) for words, _ in words_held) >= least:
            words, _, n = summed(*(np.concatenate(x) for x in zip(*words_held, strict=True)))
            words_held.clear()
            yield counted_parcels(WORD_COUNT, words, [], n, bits)

    words_held: list[tuple] = []
    for pairs, context in gathered(found()):
        yield grams_counted(pairs, context, bits)
        # Not held while the next texts are read.
        del pairs, context
        yield from words_of(HELD)
    yield from words_of(1)


def with_bits(run, bits: int):
    return lambda batches: run(batches, bits)


def gathered(found: Iterator[tuple]) -> Iterator[tuple]:
    """Tuples of arrays joined, up to ``HELD`` rows or one tuple's."""
    held, size = [], 0

    def taken_out() -> tuple:
        whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return whole

    for arrays in found:
        if size and size + len(arrays[0]) > HELD:
            yield taken_out()
            size = 0
        held.append(arrays)
        size += len(arrays[0])
    if size:
        yield taken_out()


def counted_parcels(kind: int, keys: np.ndarray, columns: list[np.ndarray], n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Counts of a byte; a key with more than 255 stands several times."""
    if len(n) and n.max() > 255:
        times = (n + 254) // 255
        last = n - 255 * (times - 1)
        at = np.repeat(np.arange(len(keys)), times)
        n = np.full(len(at), 255)
        n[np.cumsum(times) - 1] = last
        keys, columns = keys[at], [x[at] for x in columns]
    return packed(kind, keys, [*columns, n.astype(np.uint8)], bits)


def grams_counted(grams: np.ndarray, context: np.ndarray, bits: int) -> pa.RecordBatch:
    order = np.argsort(grams)
    grams = grams[order]
    starts, size = run_starts(grams), len(grams)
    grams, context = grams[starts], context[order[starts]]
    del order
    return counted_parcels(COUNT, grams, [context], np.diff(starts, append=size), bits)


def gram_hashes(words: Words, longest: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the sequences begin, words..., after of a batch one after the other: hashes of
    the grams of 1, 2, ... tokens that end at each token, each token's text number, and
    its place in the sequence. A gram longer than its place + 1 reaches over the start."""
    offsets = words.offsets
    texts, sizes = np.arange(len(offsets) - 1), np.diff(offsets)
    tokens = np.empty(len(words) + 2 * len(texts), np.uint64)
    tokens[np.arange(len(words)) + 2 * np.repeat(texts, sizes) + 1] = words.hashes(lower=True)
    tokens[offsets[:-1] + 2 * texts] = BEGIN
    tokens[offsets[1:] + 2 * texts + 1] = AFTER
    owner = np.repeat(texts, sizes + 2)
    place = np.arange(len(tokens)) - (offsets[:-1] + 2 * texts)[owner]
    grams = [tokens]
    for _ in range(longest - 1):
        last = grams[-1]
        grams.append(np.concatenate([last[:1], joined_hash(last[:-1], last[1:])]))
    return grams, owner, place


def joined_hash(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Of the gram that is ``context`` without its last token and ``suffix`` without its first."""
    return mix(combine(context, suffix))


def second_of(grams: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The suffix, of the gram's hash and its context's: every step of ``joined_hash`` can be undone."""
    return uncombine(unmix(grams), context)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def part_bits(size: int, bits: int):
    """For each part the piece of the bitmap of ``size`` bits that its keys set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = size >> bits
        for parcels in grouped(batches):
            (keys,) = taken(parcels.table)
            at = np.sort(keys >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
            starts = run_starts(at // piece)
            found = []
            for a, b in zip(starts, np.append(starts[1:], len(at)), strict=True):
                flags = np.zeros(piece, np.uint8)
                flags[at[a:b] % piece] = 1
                found.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array((at // piece)[starts], pa.int32()), pa.array(found, pa.binary())], ["segment", "bits"])

    return run


def bitmap_of(tables: list[DataFrame], bits: int):
    """Broadcast bitmap of the keys of parcels."""
    keys = [table.withColumns({c: F.lit(None).cast("binary") for c in BYTES[2:]}) for table in tables]
    n = sum(table.agg(F.sum("size")).first()[0] or 0 for table in tables)
    size = max(SEGMENT_BITS, 8 << bits)
    while size < min(MOST_BITS, GRAM_BITS * n):
        size *= 2
    # Written, so that the shuffle's files go before the bitmap is used.
    segments = meet(keys, part_bits(size, bits), "op2-bitmap", "segment int, bits binary")
    found = collect_bitmap(segments, 1 << bits, size >> bits >> 3)
    discard(segments)
    return tables[0].sparkSession.sparkContext.broadcast(found)


def counted_grams(length: int, sent, bits: int = LEAST_BITS):
    """Grams whose parts may both be frequent, with their contexts and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value

        def found():
            for batch in chunks(batches, limit=TEXT_BYTES):
                grams, _, place = gram_hashes(Words(batch.column("text")), length - 1)
                parts = grams[-1]
                maybe = in_bitmap(bitmap, parts)
                at = np.flatnonzero((place[1:] >= length - 1) & maybe[1:] & maybe[:-1])
                context = parts[at]
                yield joined_hash(context, parts[at + 1]), context

        for grams, context in gathered(found()):
            yield grams_counted(grams, context, bits)
            # Not held while the next texts are read.
            del grams, context

    return run


def frequent_grams(least: float, bits: int):
    """Grams of at least ``least`` occurrences, dealt by their suffixes, and all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.RecordBatch] = []

        def found():
            for parcels in grouped(batches):
                keys, n = parcels.take(WORD_COUNT, "u1")
                if len(keys):
                    keys, _, n = summed(keys, n.astype(np.int64))
                    words.append(packed(WORD, keys, [n], bits, weight=n))
                grams, context, n = parcels.take(COUNT, "u8", "u1")
                grams, at, n = summed(grams, n.astype(np.int64))
                kept = n >= least
                context = context[at[kept]]
                yield GRAM, second_of(grams[kept], context), [context, n[kept]]

        for batch in dealt(found(), bits):
            yield batch
            yield from words
            words.clear()
        yield from words

    return run


def with_below(size: float, least: float, bits: int):
    """Grams with the probability of their last token at their suffix, dealt by their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for parcels in grouped(batches):
                words, counts = parcels.take(WORD, "i8")
                known, below = parcels.take(BELOW, "f8")
                known, below = np.concatenate([words, known]), np.concatenate([(counts + 1) / size, below])
                order = np.argsort(known)
                suffix, context, n = parcels.take(GRAM, "u8", "i8")
                at = lookup(known[order], suffix)
                ok = (at >= 0) & (n >= least)
                yield ROW, context[ok], [suffix[ok], n[ok], below[order][at[ok]]]

        return dealt(found(), bits)

    return run


def as_contexts(bits: int):
    """Grams as what the next length's contexts are: their count and their own suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                context, suffix, n = Parcels([batch]).take(ROW, "u8", "i8")
                yield TOTAL, joined_hash(context, suffix), [n, suffix]

        return dealt(found(), bits)

    return run


class Contexts:
    """Contexts of some parts with their followers: ``keys`` ascending, per context its
    count, its own suffix and its share for that, and the grams' places among them."""

    def __init__(self, parcels: Parcels):
        words, counts = parcels.take(WORD, "i8")
        keys, n, shorter = parcels.take(TOTAL, "i8", "u8")
        keys, n, shorter = np.concatenate([words, keys]), np.concatenate([counts, n]), np.concatenate([np.zeros(len(words), np.uint64), shorter])
        order = np.argsort(keys)
        self.keys, self.n, self.shorter = keys[order], n[order], shorter[order]
        context, suffix, followed, below = parcels.take(ROW, "u8", "i8", "f8")
        at = lookup(self.keys, context)
        ok = at >= 0
        self.at, self.suffix, self.count, self.below = at[ok], suffix[ok], followed[ok], below[ok]
        self.context = context[ok]
        self.total = np.maximum(self.n[self.at], self.count)
        np.maximum.at(self.n, self.at, self.count)
        self.own = (self.count - DISCOUNT) / self.total
        self.share = 1 - self.sums(self.own)

    def sums(self, values: np.ndarray | None = None) -> np.ndarray:
        # Of no rows, bincount gives integers.
        return np.bincount(self.at, values, minlength=len(self.keys)).astype(np.float64)

    def kept(self) -> np.ndarray:
        """Divergence of what the counts say from the suffix's distribution, the other
        followers lumped into one, against half a logarithm of the count per follower."""
        plain = self.count / self.total
        rest, rest_below = np.maximum(1 - self.sums(plain), 0), np.clip(1 - self.sums(self.below), 1e-12, 1)
        kl = self.sums(plain * np.log(plain / self.below))
        kl += np.where(rest > 0, rest * np.log(np.where(rest > 0, rest, 1) / rest_below), 0)
        followers = self.sums()
        return (followers > 0) & (self.n * kl > 0.5 * followers * np.log(np.maximum(self.n, 2)))


def probabilities(bits: int):
    """Each gram's probability of its last token, which is that of a suffix for longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for x in map(Contexts, grouped(batches)):
                yield BELOW, joined_hash(x.context, x.suffix), [x.own + x.share[x.at] * x.below]

        return dealt(found(), bits)

    return run


def state_values(length: int, head_min: float, bits: int):
    """What an occurrence of each state, and of each gram that a state has seen, adds to a
    text's score; those of at least ``head_min`` occurrences apart. Also the states' suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for parcels in grouped(batches):
                x = Contexts(parcels)
                (forced,) = parcels.take(FORCED)
                states = (x.kept() | (lookup(np.unique(forced), x.keys) >= 0)) & (x.sums() > 0)
                if length > 2:
                    yield FORCED, x.shorter[states], []
                seen = states[x.at]
                gains = np.log10(1 + x.own[seen] / (x.share[x.at[seen]] * x.below[seen]))
                for keys, n, value in (
                    (x.keys[states], x.n[states], np.log10(x.share[states])),
                    (joined_hash(x.context[seen], x.suffix[seen]), x.count[seen], gains),
                ):
                    top = n >= head_min
                    yield HEAD, keys[top], [value[top]]
                    yield VALUE, keys[~top], [fixed(value[~top])]

        return dealt(found(), bits)

    return run


def frequent_words(head_min: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = Parcels([batch]).take(WORD, "i8")
            top = n >= head_min
            if top.any():
                yield packed(HEAD, words[top], [np.log10(n[top] + 1.0)], bits)

    return run


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted number among ascending keys, -1 where it is none."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Index:
    """``lookup`` of hashes in any order: where each value of their first bits begins among
    the keys is known, so a look-up touches a key or two and none for most that are absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = min(22, max(4, len(keys).bit_length() + 1))
        bounds = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.append(np.searchsorted(keys, bounds), len(keys)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted hashes are keys, and their places."""
        bucket = (wanted >> np.uint64(64 - self.bits)).astype(np.int32)
        at, end = self.first[bucket], self.first[bucket + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        which, places = [live[:0]], [at[:0]]
        while len(live):
            hit = self.keys[at] == wanted[live]
            which.append(live[hit])
            places.append(at[hit])
            at = at + 1
            more = ~hit & (at < end)
            live, at, end = live[more], at[more], end[more]
        return np.concatenate(which), np.concatenate(places)


def pick(values: np.ndarray, at: np.ndarray, otherwise: float) -> np.ndarray:
    """Values at the given places, ``otherwise`` where the place is -1."""
    out = np.full(len(at), otherwise)
    out[at >= 0] = values[at[at >= 0]]
    return out


def gram_numbers(codes: np.ndarray, place: np.ndarray, levels: list[np.ndarray]) -> list[np.ndarray]:
    """For n = 1, 2, ...: number among the frequent n-grams of the one that ends at each
    token, -1 where it is not one or would reach over the text's start."""
    found = [np.where(codes >= 0, codes, -1)]
    for n, keys in enumerate(levels, 2):
        before = np.concatenate([[-1], found[-1][:-1]])
        # The (n-1)-gram that ends one token earlier, then this token.
        ok = (before >= 0) & (codes >= 0) & (place >= n - 1) & (found[-1] >= 0)
        number = np.full(len(codes), -1, np.int64)
        number[ok] = lookup(keys, before[ok] * SHIFT + codes[ok])
        found.append(number)
    return found


class Tree:
    """The same tree on one machine, which the tables are tested against. Arrays by depth. Depth d has frequent grams of d + 1 tokens in ascending order of
    (number of the context, a d-gram) * SHIFT + follower, their final probabilities,
    and per context of d tokens: whether it is a state, and its share for the suffix."""

    def __init__(self, root: np.ndarray, rest: float, levels, states, shares, probabilities):
        self.root, self.rest = root, rest
        self.levels, self.states, self.shares, self.probabilities = levels, states, shares, probabilities

    def parts(self):
        return self.root, self.rest, self.levels, self.states, self.shares, self.probabilities

    def log10(self, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability, and the log10 of the root's part for
        tokens without code left out: they add their root probability themselves.
        Leading ends count 0."""
        levels = self.levels
        numbers = gram_numbers(codes, place, levels)
        p = np.where(codes >= 0, self.root[np.maximum(codes, 0)], self.rest)
        for d, keys in enumerate(levels, 1):
            context = np.concatenate([[-1], numbers[d - 1][:-1]])
            context[place < d] = -1
            inside = context >= 0
            inside[inside] = self.states[d - 1][context[inside]]
            p = p * pick(self.shares[d - 1], np.where(inside, context, -1), 1.0)
            seen = np.full(len(codes), -1, np.int64)
            ok = inside & (codes >= 0)
            seen[ok] = lookup(keys, context[ok] * SHIFT + codes[ok])
            p = p + pick(self.probabilities[d - 1], seen, 0.0)
        out = np.log10(p)
        out[place == 0] = 0
        return out


def grow(counts: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], n_texts: int, tokens: int, vocabulary: int) -> Tree:
    """The tree from the numbered words' counts (the end's first) and, for each depth, the
    frequent grams with theirs, on one machine."""
    root = (counts + 1) / (tokens + vocabulary + 1)
    # Words that precede something: all but the end, which as a context starts a text.
    context_counts = counts.astype(np.float64).copy()
    context_counts[END] = n_texts
    last = np.arange(len(counts))  # last token of each context
    suffix = np.full(len(counts), -1, np.int64)  # number of the context without its first token
    levels, states, shares, probabilities, parents = [], [], [], [], []

    def suffix_probability(depth: int, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Probability of a follower at contexts of ``depth`` tokens, all kept."""
        if depth == 0:
            return root[follower]
        seen = lookup(levels[depth - 1], context * SHIFT + follower)
        own = pick(probabilities[depth - 1], seen, 0.0)
        return own + shares[depth - 1][context] * suffix_probability(depth - 1, parents[depth - 1][context], follower)

    for depth, (keys, n) in enumerate(grams, 1):
        context, follower = keys // SHIFT, keys % SHIFT
        size = len(context_counts)
        total = np.maximum(context_counts[context], n)
        own = (n - DISCOUNT) / total
        share = 1 - np.bincount(context, own, minlength=size)
        suffixes = suffix_probability(depth - 1, suffix[context] if depth > 1 else context, follower)
        # Divergence of what the counts say from the suffix's distribution, the other
        # followers lumped into one, against half a logarithm of the count per follower.
        plain = n / total
        rest = np.maximum(1 - np.bincount(context, plain, minlength=size), 0)
        rest_suffix = np.clip(1 - np.bincount(context, suffixes, minlength=size), 1e-12, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            kl = np.bincount(context, plain * np.log(plain / suffixes), minlength=size)
            kl = kl + np.where(rest > 0, rest * np.log(rest / rest_suffix), 0)
        followers = np.bincount(context, minlength=size)
        kept = (followers > 0) & (context_counts * kl > 0.5 * followers * np.log(np.maximum(context_counts, 2)))
        levels.append(keys)
        parents.append(suffix)
        probabilities.append(own)
        shares.append(share)
        states.append(kept)
        # The grams of this depth are the next depth's contexts; without their first
        # token they are grams of the depth before.
        if depth == 1:
            suffix = follower
        else:
            suffix = lookup(levels[depth - 2], suffix[context] * SHIFT + follower)
        context_counts, last = n.astype(np.float64), follower
    # A kept context keeps its suffixes.
    for depth in range(len(states) - 1, 0, -1):
        mine = parents[depth][states[depth]]
        states[depth - 1][mine[mine >= 0]] = True
    return Tree(root, 1 / (tokens + vocabulary + 1), levels, states, shares, probabilities)


def scored(longest: int, head, sent, bits: int = LEAST_BITS):
    """Requests for the values that are not broadcast, each with its text's place among those of a source,
    and per source the texts with what the broadcast values add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *values = head.value
        order = np.argsort(keys.view(np.uint64))
        index, values = Index(keys.view(np.uint64)[order]), [x[order] for x in values]
        bitmap = sent.value

        def texts():
            for batch in chunks(batches, limit=TEXT_BYTES):
                for a in range(0, batch.num_rows, SOURCE_TEXTS):
                    yield batch.slice(a, SOURCE_TEXTS)

        def source(held):
            asked, owner, tops = zip(*held, strict=True)
            held.clear()
            asked, owner = np.concatenate(asked), np.concatenate(owner)
            order = np.argsort(asked)
            asked, owner = asked[order], owner[order]
            ids, doc_ids, flags, n_tokens, sums = (np.concatenate(x) for x in zip(*tops, strict=True))
            yield packed(REQUEST, asked, [owner], bits, int(ids[0]))
            part = int(mix(ids[:1].astype(np.uint64) + BEGIN)[0] >> np.uint64(64 - bits))
            yield rows(TOP, part, int(ids[0]), np.zeros(1, np.int64), len(ids), [sums, None, doc_ids, flags, n_tokens])

        held, size, n_texts = [], 0, 0
        for batch in texts():
            words, n = Words(batch.column("text")), batch.num_rows
            if held and (size >= HELD or n_texts + n > SOURCE_TEXTS):
                yield from source(held)
                size, n_texts = 0, 0
            grams, owner, place = gram_hashes(words, longest)
            sums, asked, owners = np.zeros((n, len(values))), [], []
            known = np.arange(len(place))
            for length, found in enumerate(grams, 1):
                # A gram with a value has a suffix with one: states are closed under suffixes, and so is what they have seen.
                known = known[place[known] >= length - 1]
                known = known[in_bitmap(bitmap, found[known])]
                own, found = owner[known], found[known]
                top, at = index.find(found)
                # Only words add to the base score and are known.
                for i in range(0 if length == 1 else 2, len(values)):
                    sums[:, i] += np.bincount(own[top], values[i][at], minlength=n)
                rest = np.ones(len(found), bool)
                rest[top] = False
                asked.append(found[rest])
                owners.append((own[rest] + n_texts).astype(np.uint16))
            asked, owners = np.concatenate(asked), np.concatenate(owners)
            doc_ids, training = batch.column("doc_id"), batch.column("training")
            flags = np.array(training.fill_null(False)).astype(np.uint8) + 2 * np.array(training.is_null()) + 4 * np.array(doc_ids.is_null())
            ids = batch.column("row").to_numpy()
            tops = (ids, np.array(doc_ids.fill_null(0)), flags.astype(np.uint8), np.diff(words.offsets) + 1, sums)
            held.append((asked, owners, tops))
            size += len(asked)
            n_texts += n
        if held:
            yield from source(held)

    return run


class RowSums:
    """Sums for texts, by the number of their source and their place in it."""

    def __init__(self):
        self.sources: dict[int, int] = {}
        self.held: list[tuple] = []
        self.size = 0

    def add(self, sources: np.ndarray, sizes: np.ndarray, place: np.ndarray, at: np.ndarray, values) -> None:
        """Of requests (sources of parcels, their sizes, texts) those that have a value."""
        number = np.array([self.sources.setdefault(int(x), len(self.sources)) for x in sources], np.int64)
        ok = at >= 0
        code = (np.repeat(number, sizes) * SOURCE_TEXTS + place)[ok]
        code, _, *sums = summed(code, *(x[at[ok]] for x in values))
        self.held.append((code, *sums))
        self.size += len(code)
        if self.size >= HELD:
            self.merge()

    def merge(self) -> None:
        code, *sums = (np.concatenate(x) for x in zip(*self.held, strict=True))
        code, _, *sums = summed(code, *sums)
        self.held, self.size = [(code, *sums)], len(code)

    def parcels(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        self.merge()
        code, *sums = self.held[0]
        number = code // SOURCE_TEXTS
        starts = run_starts(number)
        sources = np.array(list(self.sources), np.int64)[number[starts]]
        yield rows(ANSWER, 0, sources, starts, len(code), [(code % SOURCE_TEXTS).astype(np.uint16), None, *sums])
        self.held, self.size = [], 0


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the requested values add up to for each text, and the sources' texts."""
    sums = RowSums()
    for parcels in grouped(batches):
        yield from parcels.of(TOP).to_batches()
        words, n = parcels.take(WORD, "i8")
        # The mark before a text is a context and no token.
        words, n = words[words != BEGIN], n[words != BEGIN]
        keys, extra = parcels.take(VALUE, "s6")
        nothing, none = np.zeros(len(words), np.int64), np.zeros(len(keys), np.int64)
        base = units(fixed(np.log10(n + 1.0)))
        found = summed(
            np.concatenate([words, keys]),
            np.concatenate([nothing, units(extra)]),
            np.concatenate([base, none]),
            np.concatenate([nothing + 1, none]),
        )
        asked = parcels.of(REQUEST)
        wanted, place = taken(asked, "u2")
        if len(wanted):
            sizes = asked.column("size").to_numpy()
            sums.add(asked.column("source").to_numpy(), sizes, place, lookup(found[0], wanted), found[2:])
        if sums.size >= HELD:
            yield from sums.parcels()
    yield from sums.parcels()


SCORES = "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def totals(tokens: int, size: float):
    """A row per text: what broadcast and requested values add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parcels in grouped(batches, "source"):
            sources = parcels.table.column("source").to_numpy()
            starts = run_starts(sources)
            for a, b in zip(starts, np.append(starts[1:], len(sources)), strict=True):
                own = parcels.table.slice(a, b - a)
                top, found = (own.filter(pa.array(parcels.kinds[a:b] == kind)) for kind in (TOP, ANSWER))
                base, known, extra = content(top.column("c0"), "f8").reshape(-1, 3).T
                place, more = content(found.column("c0"), "u2"), [content(found.column(c), "i8") for c in ("c2", "c3", "c4")]
                sums = [np.zeros(len(base), np.int64) for _ in more]
                for total, value in zip(sums, more, strict=True):
                    np.add.at(total, place, value)
                flags, n_tokens = content(top.column("c3"), "u1"), content(top.column("c4"), "i8")
                base = base + sums[1] / UNITS - n_tokens * np.log10(size)
                fields = [
                    pa.array(content(top.column("c2"), "i8"), mask=flags & 4 > 0),
                    pa.array(flags & 1 > 0, mask=flags & 2 > 0),
                    pa.array(n_tokens),
                    pa.array(np.rint(known).astype(np.int64) + sums[2]),
                    pa.array(np.full(len(base), tokens, np.int64)),
                    pa.array(base),
                    pa.array(base + extra + sums[0] / UNITS),
                ]
                yield pa.RecordBatch.from_arrays(fields, [x.split()[0] for x in SCORES.split(", ")])

    return run


def tree_values(
    training: DataFrame, words: DataFrame, pairs: DataFrame, size: float, depth: int, least: float, head_min: float, bits: int
) -> list[DataFrame]:
    """Tables of the values that an occurrence of each context and gram adds to a text's
    score (``VALUE``), and of those that are broadcast (``HEAD``)."""
    levels, contexts, below, grams = [], words, words, pairs
    for length in range(2, depth + 2):
        if length > 2:
            bitmap = bitmap_of([below], bits)
            counts = training.mapInArrow(counted_grams(length, bitmap, bits), PARCEL)
            grams = meet([counts], frequent_grams(least, bits), f"op2-grams{length}")
            # Its copies take disk on every executor.
            bitmap.destroy()
        found = meet([of_kind(grams, GRAM), below], with_below(size, least, bits), f"op2-rows{length}")
        discard(grams, *([below] if length > 2 else []))
        if length <= depth:
            below = meet([found, contexts], probabilities(bits), f"op2-below{length}")
        levels.append((contexts, found))
        contexts = found.mapInArrow(as_contexts(bits), PARCEL)
    values: list[DataFrame] = []
    # The longest first: a kept context keeps its suffixes.
    for length, (contexts, found) in reversed([*enumerate(levels, 2)]):
        forced = [of_kind(values[-1], FORCED)] if values else []
        values.append(meet([found, contexts, *forced], state_values(length, head_min, bits), "op2-gains"))
        discard(found)
    return values


def head_of(words: DataFrame, values: list[DataFrame], head_min: float, bits: int) -> list[np.ndarray]:
    """Keys in ascending order, and what each adds to a text's base score, known words and score."""
    word, base = taken(words.mapInArrow(frequent_words(head_min, bits), PARCEL).toArrow(), "f8")
    word, base = word[word != BEGIN], base[word != BEGIN]
    found = [taken(of_kind(table, HEAD).toArrow(), "f8") for table in values]
    keys = np.concatenate([word, *(x for x, _ in found)])
    extra = np.concatenate([np.zeros(len(word)), *(x for _, x in found)])
    none = np.zeros(len(keys) - len(word))
    keys, _, *sums = summed(keys.view(np.int64), np.concatenate([base, none]), np.concatenate([np.ones(len(word)), none]), extra)
    return [keys, *sums]


def score_texts(docs: DataFrame, training, depth: int = DEPTH, p_min: float = 0.0) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``.

    ``training``: a condition on ``docs``; other texts are only scored. Needs
    doc_id and text, other columns are ignored. A null or empty text is its end
    token alone. Repeated rows are scored, and learned from, each time. Without
    training texts every token has the same probability. An empty table gives an
    empty result. Words and grams are told apart by 64-bit hashes. ``p_min``: a
    share of the tokens that grams must have as well, none unless asked for.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", training.alias("training"))
    learned = read.where("training").select("text")
    with small_batches(spark):
        sums = learned.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
        n_texts = sums["n"]
        bits = min(MOST_PART_BITS, max(LEAST_BITS, ((sums["bytes"] or 0) // PART_BYTES).bit_length()))
        pairs = meet([learned.mapInArrow(with_bits(word_counts, bits), PARCEL)], frequent_grams(LEAST, bits), "op2-grams2")
        words = durable(of_kind(pairs, WORD), "op2-words")
        sums = words.agg(F.sum("weight").alias("n"), F.sum("size").alias("v")).first()
        # Both marks are among the words; one is a token.
        tokens, vocabulary = (sums["n"] or 0) - n_texts, (sums["v"] or 0) - (n_texts > 0)
        size = float(tokens + vocabulary + 1)
        head_min = HEAD_MIN * tokens
        values = tree_values(learned, words, pairs, size, depth, max(float(LEAST), p_min * tokens), head_min, bits)
        # At most 1 / HEAD_MIN of each length, and the marks around texts.
        head = spark.sparkContext.broadcast(head_of(words, values, head_min, bits))
        others = [words, *(of_kind(table, VALUE) for table in values)]
        known = bitmap_of([*others, *(of_kind(table, HEAD) for table in values)], bits)
        request = scored(depth + 1, head, known, bits)
        # A slice of the texts at a time, so that disk holds neither all requests nor all answers beside the values.
        slice_of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES))
        answers = [
            meet([*others, read.where(slice_of == i).withColumn("row", F.monotonically_increasing_id()).mapInArrow(request, PARCEL)], answered, "op2-answers")
            for i in range(SLICES)
        ]
        discard(words, *values)
        head.destroy()
        known.destroy()
        found = meet(with_own_sources(answers), totals(tokens, size), "op2-values", SCORES, "source")
        discard(*answers)
    return found


def with_own_sources(answers: list[DataFrame]) -> list[DataFrame]:
    """Sources of several slices told apart."""
    return [table.withColumn("source", F.col("source") * len(answers) + i) for i, table in enumerate(answers)]


def query(spark, sf_dir: str) -> DataFrame:
    from scriptledger.llm.shared import documents

    docs = documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long"))
    return score_texts(docs, is_training()).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )

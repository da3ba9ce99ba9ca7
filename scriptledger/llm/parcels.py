"""Tables of 64-bit keys in parcels: a row holds the keys of one part (their first bits),
in ascending order, and what belongs to them, as bytes. Spark deals out and sorts parcels,
numpy reads them; so a shuffle costs a few bytes a key and no work of the JVM for each.

Columns: ``part``, ``kind`` (what the parcel holds), ``source`` (of parcels that are
gathered by it), ``size`` (keys), ``weight`` (a sum that is read without the parcel),
``c0`` and ``c1`` (the keys' last six bytes and first two, which change seldom and
compress), ``c2`` to ``c4``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptledger.llm.shared import durable

BYTES = ("c0", "c1", "c2", "c3", "c4")
PARCEL = "part int, kind int, source long, size int, weight long, " + ", ".join(f"{c} binary" for c in BYTES)
#: Keys that a task gathers before it cuts them to parcels.
HELD = 1 << 20
#: Fixed-point numbers of six bytes: units in 1, and what is added to leave no negative one.
UNITS, OFFSET = 2.0**41, 1 << 47


def six(x: np.ndarray) -> np.ndarray:
    """The last six bytes of 64-bit numbers, a row each."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6]


def fixed(x: np.ndarray) -> np.ndarray:
    """Numbers between -64 and 64 in six bytes; sums of ``units`` do not depend on their order."""
    return six(np.rint(x * UNITS).astype(np.int64) + OFFSET)


def units(raw: np.ndarray) -> np.ndarray:
    return wide(raw).view(np.int64) - OFFSET


def wide(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def cut(starts: np.ndarray, n: int, column: np.ndarray | None) -> pa.Array:
    """A column of ``n`` rows as one value for each run that begins at ``starts``."""
    if column is None:
        return pa.nulls(len(starts), pa.binary())
    column = np.ascontiguousarray(column)
    places = (np.append(starts, n) * (column.nbytes // max(n, 1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(column)])


def rows(kind: int, part, source, starts: np.ndarray, n: int, columns, weight=None) -> pa.RecordBatch:
    """Parcels whose first keys stand at ``starts``; ``columns``: arrays for ``BYTES``, or None."""
    every = len(starts)
    columns = [*columns, *[None] * (len(BYTES) - len(columns))]
    fields = [
        pa.array(np.broadcast_to(np.asarray(part, np.int32), every)),
        pa.array(np.full(every, kind, np.int32)),
        pa.array(np.broadcast_to(np.asarray(source, np.int64), every)),
        pa.array(np.diff(np.append(starts, n)).astype(np.int32)),
        pa.array(np.zeros(every, np.int64) if weight is None else np.add.reduceat(weight, starts).astype(np.int64)),
        *(cut(starts, n, x) for x in columns),
    ]
    return pa.RecordBatch.from_arrays(fields, ["part", "kind", "source", "size", "weight", *BYTES])


def packed(kind: int, keys: np.ndarray, columns, bits: int, source: int = 0, weight=None) -> pa.RecordBatch:
    """Parcels of ascending keys, their first ``bits`` bits being their part."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int32)
    starts = run_starts(part)
    raw = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)
    return rows(kind, part[starts], source, starts, len(keys), [raw[:, :6], raw[:, 6:], *columns], weight)


def run_starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order, a place of each among the given ones, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = run_starts(keys)
    return keys[starts], order[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values)


def dealt(found: Iterator[tuple], bits: int) -> Iterator[pa.RecordBatch]:
    """Parcels of (kind, keys, columns) in any order."""
    held: dict[int, list] = {}
    for kind, keys, columns in found:
        if len(keys):
            held.setdefault(kind, []).append((keys, *columns))
        if sum(len(x[0]) for x in held.get(kind, ())) >= HELD:
            yield sorted_parcels(kind, held.pop(kind), bits)
    for kind, gathered in held.items():
        yield sorted_parcels(kind, gathered, bits)


def sorted_parcels(kind: int, gathered: list, bits: int) -> pa.RecordBatch:
    keys, *columns = (np.concatenate(x) for x in zip(*gathered, strict=True))
    order = np.argsort(keys)
    return packed(kind, keys[order], [x[order] for x in columns], bits)


def content(column: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    """A column's bytes as one array; ``s6``: rows of six bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        raw = np.zeros(0, np.uint8)
    else:
        _, places, data = column.buffers()
        bounds = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    # A copy, as bytes of Arrow need not stand where numbers may.
    return raw.reshape(-1, 6) if dtype == "s6" else np.frombuffer(raw.tobytes(), dtype)


class Parcels:
    """The parcels of some parts."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.table = pa.Table.from_batches(batches).combine_chunks()
        self.kinds = self.table.column("kind").to_numpy()

    def of(self, kind: int) -> pa.Table:
        return self.table.filter(pa.array(self.kinds == kind))

    def take(self, kind: int, *dtypes: str) -> tuple[np.ndarray, ...]:
        """Keys of a kind, and its columns."""
        return taken(self.of(kind), *dtypes)


def taken(found: pa.Table, *dtypes: str) -> tuple[np.ndarray, ...]:
    raw = np.empty((int(pc.sum(found.column("size")).as_py() or 0), 8), np.uint8)
    raw[:, :6], raw[:, 6:] = content(found.column("c0"), "s6"), content(found.column("c1"), "u1").reshape(-1, 2)
    return raw.view(np.uint64).ravel(), *(content(found.column(c), t) for c, t in zip(BYTES[2:], dtypes, strict=False))


def grouped(batches: Iterator[pa.RecordBatch], by: str = "part") -> Iterator[Parcels]:
    """Of rows in the order of ``by``: whole parts, as many as a batch completes."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(by).to_numpy()
        begun = int(np.searchsorted(parts, parts[-1]))
        if held and (begun or last != parts[-1]):
            yield Parcels([*held, batch.slice(0, begun)])
            held = []
        elif begun:
            yield Parcels([batch.slice(0, begun)])
        held.append(batch.slice(begun))
        last = parts[-1]
    if held:
        yield Parcels(held)


def of_kind(table: DataFrame, kind: int, *kept: str) -> DataFrame:
    """The parcels of a kind with only some of the columns of ``BYTES``."""
    dropped = {c: F.lit(None).cast("binary") for c in BYTES if kept and c not in kept}
    return table.where(F.col("kind") == kind).withColumns(dropped)


def meet(tables: list[DataFrame], run: Callable, name: str, schema: str = PARCEL, by: str = "part") -> DataFrame:
    """Written: ``run`` on parcels, those of a part following each other by their kind."""
    together = reduce(DataFrame.unionAll, tables).repartition(by).sortWithinPartitions(by, "kind")
    return durable(together.mapInArrow(run, schema), name)

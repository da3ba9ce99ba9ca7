"""CSV files with quoted line breaks, read by several tasks a file.

Spark's text scan cuts files at byte ranges and gives physical lines, in order, to
the range they start in. Whether a line starts a record depends on whether a
quote is open before it, hence on all before it. Two scans settle that:

1. Each range tells what it does to either state, a record's start or within quotes,
   and the first record of a file is its header. Lines without quotes change
   nothing and are dropped where they are read.
2. The effects of a file's ranges, composed in order, give the state that each one
   starts in; records are then put together and parsed in every range alone.

A record that crosses a border leaves a piece in each range; those pieces meet
by a grouping on where the record started.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A field that is complete: quoted (doubled quotes within; what follows the closing
# quote belongs to it) or plain.
_FIELD = '(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
_OPEN = f'(?:{_FIELD},)*"(?:[^"]|"")*'
#: Lines that end within quotes if they start a record, or if they start within quotes.
OPENS = f"^{_OPEN}$"
STAYS_OPEN = f'^(?:[^"]|"")*(?:"(?:[^",][^,]*)?,{_OPEN})?$'
#: Ranges that a filter on pieces lists one by one.
LISTED_RANGES = 500


@dataclass
class Ranges:
    """What is known of ranges with quotes, sorted by file and start: ``open``
    whether each starts within quotes and ``ends_open``, the start of the range where
    the record that is open at its start or end began (``origin``, ``end_origin``),
    and ``headers``: of each file, which one."""

    files: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    open: np.ndarray
    ends_open: np.ndarray
    origin: np.ndarray
    end_origin: np.ndarray
    headers: dict[int, int]

    def at(self, file: int, start: int, length: int) -> tuple[bool, int, bool]:
        """Whether a range starts within quotes, where that record began, and whether
        the range was seen in the first scan."""
        a, b = np.searchsorted(self.files, [file, file + 1]) if file < 2**63 - 1 else (np.searchsorted(self.files, file), len(self.files))
        i = a + int(np.searchsorted(self.starts[a:b], start))
        if i < b and self.starts[i] == start:
            if self.lengths[i] != length:
                raise recut()
            return bool(self.open[i]), int(self.origin[i]), True
        if i == a:
            return False, 0, False
        return bool(self.ends_open[i - 1]), int(self.end_origin[i - 1]), False


def recut() -> RuntimeError:
    return RuntimeError("files are cut into other ranges than when they were first read; leave spark.sql.files settings as they were")


def effects(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line ends within quotes if it starts a record, and if it starts
    within quotes."""
    opens, stays = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(quoted):
        some = lines.take(pa.array(quoted))
        for out, pattern in ((opens, OPENS), (stays, STAYS_OPEN)):
            out[quoted] = pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
    return opens, stays


def states(opens: np.ndarray, stays: np.ndarray, start: bool) -> np.ndarray:
    """Whether a quote is open before each line, and after the last. A line sets the
    state, keeps it or turns it; the state is what the last setter left, turned as often
    as lines since then turn it."""
    turns = np.concatenate([[0], np.cumsum(opens & ~stays)])
    sets = np.concatenate([[-1], np.where(opens == stays, np.arange(len(opens)), -1)])
    last = np.maximum.accumulate(sets)
    base = np.where(last >= 0, opens[np.maximum(last, 0)] if len(opens) else False, start)
    return base ^ (((turns - turns[np.where(last >= 0, last + 1, 0)]) & 1) == 1)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """Rows of one range, in order, piece by piece."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start", "length")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield tuple(int(x) for x in keys[:, a]), batch.slice(a, b - a)


def is_blank(record: bytes) -> bool:
    return not record.rstrip(b"\r")


EFFECT = "file long, start long, length long, opens boolean, stays boolean, resumes boolean, path string, header binary"


def range_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per range: the state it ends in from either state, and whether a record starts
    in it if it starts within quotes; of a file's first range the first record too."""
    key, now, resumes, path, header, held = None, (False, True), False, None, None, []

    def done() -> pa.RecordBatch:
        row = [*key, *map(bool, now), bool(resumes), path, header]
        kinds = [pa.int64()] * 3 + [pa.bool_()] * 3 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in EFFECT.split(", ")])

    for mine, rows in runs(batches):
        if mine != key:
            if key is not None:
                yield done()
            key, now, resumes, path, header, held = mine, (False, True), False, rows.column("path")[0].as_py(), None, []
        lines = rows.column("line")
        opens, stays = effects(lines)
        from_record, from_quotes = states(opens, stays, now[0]), states(opens, stays, now[1])
        resumes |= bool((~from_quotes[:-1]).any())
        if key[1] == 0 and header is None:
            for i in range(len(lines)):
                held.append(lines[i].as_py())
                if not from_record[i + 1]:
                    record, held = b"\n".join(held), []
                    if not is_blank(record):
                        header = record
                        break
        now = (from_record[-1], from_quotes[-1])
    if key is not None:
        yield done()


def compose(table: pa.Table, headers: dict[int, int]) -> Ranges:
    """Start and end states of all ranges, file by file."""
    rows = sorted(table.select(["file", "start", "length", "opens", "stays", "resumes"]).to_pylist(), key=lambda r: (r["file"], r["start"]))
    found: dict[str, list] = {name: [] for name in ("open", "ends_open", "origin", "end_origin")}
    file, now, origin = None, False, 0
    for row in rows:
        if row["file"] != file:
            file, now, origin = row["file"], False, 0
        found["open"].append(now)
        found["origin"].append(origin)
        if not now or row["resumes"]:
            origin = row["start"]
        now = row["stays"] if now else row["opens"]
        found["ends_open"].append(now)
        found["end_origin"].append(origin)
    column = lambda name: np.array([r[name] for r in rows], np.int64)
    state = {name: np.array(x, bool if "open" in name else np.int64) for name, x in found.items()}
    return Ranges(column("file"), column("start"), column("length"), headers=headers, **state)


RECORD = "header int, file long, origin long, place long, record binary"


def records(ranges, pieces: bool):
    """Records of each range but for headers, or the pieces of records that cross its
    borders (``origin``: the range in which the record began)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranges.value
        key, now, origin, wants_header, held = None, False, 0, False, []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RECORD.split(", ")])

        def put(lines: list[bytes], whole: bool) -> None:
            nonlocal wants_header
            record = b"\n".join(lines)
            if whole and wants_header:
                wants_header = is_blank(record)
            elif whole != pieces and not (whole and is_blank(record)):
                out.append((known.headers[key[0]], key[0], origin, key[1], record))

        for mine, rows in runs(batches):
            if mine != key:
                if held:  # the record goes on in the next range
                    put(held, False)
                key, held, wants_header = mine, [], mine[1] == 0
                now, origin, seen = known.at(*mine)
                crossing = now
                if not now:
                    origin = key[1]
            lines = rows.column("line")
            if not seen and pc.any(pc.match_substring(lines, '"')).as_py():
                raise recut()
            opens, stays = effects(lines)
            open_ = states(opens, stays, now)
            if not held and not open_.any() and not wants_header and not pieces:
                # Every line is a record, as nearly all are.
                if out:
                    yield batch()
                kept = lines.filter(pc.invert(pc.is_in(lines, value_set=pa.array([b"", b"\r"], pa.binary()))))
                n = len(kept)
                constant = [pa.array(np.full(n, x, t)) for x, t in ((known.headers[key[0]], np.int32), (key[0], np.int64), (key[1], np.int64), (key[1], np.int64))]
                yield pa.RecordBatch.from_arrays([*constant, kept], [f.split()[0] for f in RECORD.split(", ")])
                continue
            for line, after in zip(lines.to_pylist(), open_[1:], strict=True):
                held.append(line)
                if not after:
                    put(held, not crossing)
                    held, crossing, origin = [], False, key[1]
            now = bool(open_[-1])
            yield batch()
        if held:
            put(held, False)
        yield batch()

    return run


def read_csv_records(spark: SparkSession, paths: Sequence[str], header: dict[str, str], encoding: str) -> DataFrame:
    """Columns of ``header`` (name in the file to name) of all files, as strings.

    One row a range of the files is collected, and one header a file. Each file
    is read by its own header. Empty lines are no records; lines end with LF or CR LF.
    """
    raw = spark.read.option("lineSep", "\n").text(list(paths))
    raw = raw.select(
        # No filter on the path itself: that would leave out files and cut the others anew.
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        F.col("_metadata.file_path").alias("path"),
        F.col("value").cast("binary").alias("line"),
    )
    at_start = F.col("start") == 0
    first = raw.withColumn("path", F.when(at_start, F.col("path"))).where(at_start | F.col("line").contains(F.lit(b'"')))
    found = first.mapInArrow(range_effects, EFFECT).toArrow()
    texts: dict[bytes, int] = {}
    header_of, names_of = {}, {}
    for row in found.select(["file", "path", "header"]).filter(pc.is_valid(found.column("path"))).to_pylist():
        if row["file"] in names_of and names_of[row["file"]] != row["path"]:
            raise RuntimeError(f"{row['path']} and {names_of[row['file']]} have one hash")
        names_of[row["file"]] = row["path"]
        header_of[row["file"]] = texts.setdefault(row["header"] or b"", len(texts))
    if len(header_of) < len(paths):
        raise ValueError(f"a file lacks columns {list(header)}: {len(paths) - len(header_of)} of {list(paths)[:20]} are empty")
    places = []
    for text, number in texts.items():
        names = next(csv.reader(io.StringIO(text.decode(encoding).rstrip("\r"), newline="")), [])
        absent = [name for name in header if name not in names]
        if absent:
            raise ValueError(f"{next(names_of[f] for f, n in header_of.items() if n == number)} lacks columns {absent}")
        places.append((len(names), [names.index(name) for name in header], text.endswith(b"\r")))
    ranges = compose(found, header_of)
    sent = spark.sparkContext.broadcast(ranges)
    lines = raw.drop("path")
    whole = lines.mapInArrow(records(sent, False), RECORD).select("header", decoded("record", encoding))
    if ranges.open.any() or ranges.ends_open.any():
        crossing = lines.where(crossing_ranges(ranges)).mapInArrow(records(sent, True), RECORD)
        joined = crossing.groupBy("header", "file", "origin").agg(
            F.array_sort(F.collect_list(F.struct("place", decoded("record", encoding)))).alias("pieces")
        )
        whole = whole.unionAll(joined.select("header", F.array_join("pieces.record", "\n").alias("record")))
    return parsed(whole, places, list(header.values()))


def crossing_ranges(ranges: Ranges) -> Column:
    """Condition on ranges that start or end within quotes, and any between them."""
    involved = np.flatnonzero(ranges.open | ranges.ends_open)
    if len(involved) > LISTED_RANGES:
        return F.lit(True)
    out = F.lit(False)
    for i in involved:
        # Up to the file's next range with quotes, lines without any may continue the record.
        end = int(ranges.starts[i + 1]) if i + 1 < len(ranges.files) and ranges.files[i + 1] == ranges.files[i] else 2**63 - 1
        upper = F.col("start") < end if ranges.ends_open[i] else F.col("start") == int(ranges.starts[i])
        out = out | ((F.col("file") == int(ranges.files[i])) & (F.col("start") >= int(ranges.starts[i])) & upper)
    return out


def decoded(column: str, encoding: str) -> Column:
    return F.decode(F.col(column), encoding).alias(column)


def parsed(rows: DataFrame, places: list[tuple[int, list[int], bool]], names: list[str]) -> DataFrame:
    """Fields of records by the places that their header gives them. Of files whose
    lines end with CR LF, breaks within quotes become LF."""
    options = {"escape": '"', "multiLine": "true"}

    def fields(count: int, chosen: list[int], carriage: bool) -> Column:
        text = F.rtrim(F.col("record"), F.lit("\r"))
        kind = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(count)])
        one = F.array(F.from_csv(F.replace(text, F.lit("\r\n"), F.lit("\n")) if carriage else text, kind.simpleString(), options))
        return F.transform(one, lambda r: F.struct(*[r[f"c{i}"].alias(n) for i, n in zip(chosen, names, strict=True)]))[0]

    value = fields(*places[0])
    for number, place in enumerate(places[1:], 1):
        value = F.when(F.col("header") == number, fields(*place)).otherwise(value)
    return rows.select(value.alias("r")).select("r.*")

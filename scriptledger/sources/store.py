"""Versioned tables: written beside the old ones, then published together.

Every write of a table goes to a folder of its own. What is where stands in a log, to
which a writer adds one small file at a time: a line per written table (``step``),
and at the end of a build a file with a line per table that belongs to it
(``build``). Spark's committer shows a file whole or not at all, so readers
have the tables of the last published build until the next one is there, and a build
that fails leaves nothing but folders that no build names.

The same log lets a build go on where another stopped: a step's fingerprint tells
what it was made from, and a table with that fingerprint need not be written again.

One writer at a time; any number of readers.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass
from types import ModuleType
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "kind string, number long, id string, table string, path string, fingerprint string, rows long, passed array<string>"


@dataclass(frozen=True)
class Written:
    """A version of a table: its folder below the store, what it was made from, its rows,
    and the checks that it was seen to pass when it was written."""

    table: str
    path: str
    fingerprint: str | None
    rows: int
    passed: tuple[str, ...] = ()


def fingerprint(*parts: Any) -> str:
    """Of values that JSON can write."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def code_fingerprint(modules: Iterable[ModuleType]) -> str:
    """Changes with the source of any of the modules."""
    return fingerprint(*[inspect.getsource(module) for module in modules])


def files_fingerprint(spark: SparkSession, paths: Collection[str]) -> str:
    """Of names, sizes and times of change; the files are not read."""
    found = spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.col("modificationTime").cast("string"))
    return fingerprint(*sorted(map(list, found.collect())))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._last: int | None = None

    def new_path(self, layer: str, table: str) -> str:
        """Where the next version of a table goes, below the store."""
        return f"{layer}/{table}/{uuid.uuid4().hex}"

    def at(self, path: str) -> str:
        return f"{self.root}/{path}"

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(LOG).json(f"{self.root}/log")
        except AnalysisException:  # nothing was written yet
            return None

    def _lines(self, kind: str) -> list:
        log = self._log()
        return [] if log is None else sorted(log.where(F.col("kind") == kind).collect(), key=lambda r: (r.number, r.id))

    def _add(self, kind: str, tables: Iterable[Written]) -> None:
        if self._last is None:
            log = self._log()
            self._last = 0 if log is None else log.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        self._last += 1
        made = uuid.uuid4().hex
        lines = [(kind, self._last, made, w.table, w.path, w.fingerprint, w.rows, list(w.passed)) for w in tables]
        self.spark.createDataFrame(lines, LOG).coalesce(1).write.mode("append").json(f"{self.root}/log")

    @staticmethod
    def _written(row) -> Written:
        return Written(row.table, row.path, row.fingerprint, row.rows, tuple(row.passed or ()))

    def steps(self) -> dict[str, Written]:
        """The last version of each table that was written whole, published or not."""
        return {row.table: self._written(row) for row in self._lines("step")}

    def made_from(self, wanted: Collection[str]) -> dict[str, Written]:
        """Written tables by fingerprint, of those asked for."""
        return {row.fingerprint: self._written(row) for row in self._lines("step") if row.fingerprint in wanted}

    def record(self, written: Iterable[Written]) -> None:
        """Tables that are written whole."""
        written = list(written)
        if written:
            self._add("step", written)

    def published(self, back: int = 0) -> dict[str, Written]:
        """Tables of the last published build, or of one ``back`` builds earlier."""
        lines = self._lines("build")
        builds = sorted({(row.number, row.id) for row in lines}, reverse=True)
        if back >= len(builds):
            return {}
        return {row.table: self._written(row) for row in lines if (row.number, row.id) == builds[back]}

    def publish(self, tables: Mapping[str, Written]) -> None:
        """From now on, readers get these tables, and those of the build before that are
        not among them."""
        self._add("build", {**self.published(), **tables}.values())

    def remove_unpublished(self, keep: int = 1) -> list[str]:
        """Delete the versions that none of the last ``keep`` builds names, and say which.
        Not while a build is running."""
        named = {w.path for back in range(keep) for w in self.published(back).values()}
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs.Path
        removed = []
        for path in dict.fromkeys(row.path for kind in ("step", "build") for row in self._lines(kind)):
            place = hadoop(self.at(path))
            system = place.getFileSystem(context._jsc.hadoopConfiguration())
            if path not in named and system.exists(place):
                system.delete(place, True)
                removed.append(path)
        return removed

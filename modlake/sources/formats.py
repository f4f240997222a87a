"""Python data sources: segment CSVs and WAV files by format name, in partitions, with pushed filters.

``register(spark)`` makes ``spark.read.format("segments")`` and ``.format("wav")`` known. Files are opened where a task runs, by
Arrow's file systems (local or shared folders, HDFS, object stores). A store that only Spark's own readers reach is for
``read_segments_csv`` and ``audio_files`` of ``modlake.sources.manifests``, which give the same rows.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from modlake.sources.manifests import samples_at

#: Bytes of a partition, unless the option ``partitionBytes`` says otherwise; lines of a batch.
PARTITION_BYTES, LINES = 64 << 20, 20_000
#: Filters by how they hold for a value that isn't null.
_HOLDS: dict[type, Callable] = {
    D.EqualTo: lambda x, f: x == f.value, D.In: lambda x, f: x in f.value, D.GreaterThan: lambda x, f: x > f.value, D.GreaterThanOrEqual: lambda x, f: x >= f.value,
    D.LessThan: lambda x, f: x < f.value, D.LessThanOrEqual: lambda x, f: x <= f.value, D.StringStartsWith: lambda x, f: x.startswith(f.value),
    D.StringEndsWith: lambda x, f: x.endswith(f.value), D.StringContains: lambda x, f: f.value in x, D.IsNotNull: lambda x, f: True,
}


@dataclass
class Part(D.InputPartition):
    """Files with the bytes of each that a task reads."""

    files: list[tuple[str, int, int]]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Files of a folder and below, or the file, with their sizes by name; hidden ones and those of writers are left out."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda f: any(p[:1] in "._" for p in f.path[len(at) :].split("/") if p)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not hidden(f))


class _Reader(D.DataSourceReader):
    """Takes the filters on ``columns`` that it can apply itself."""

    columns: tuple[str, ...] = ()

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.rate, self.filters = int(options.get("rate", 16000)), []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _HOLDS and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.filters.append(f)
            else:
                yield f

    def holds(self, row: dict) -> bool:
        return all((x := row[f.attribute[0]]) is not None and _HOLDS[type(f)](x, f) for f in self.filters)


class SegmentsReader(_Reader):
    columns = ("ytid", "start", "end")

    def partitions(self):
        """Ranges of bytes; a line belongs to the range in which it begins."""
        return [Part([(p, a, min(a + self.size, n))]) for p, n in _listed(self.path) for a in range(0, n, self.size)] or [Part([])]

    def read(self, partition):
        schema = pa.schema([("ytid", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("mids", pa.list_(pa.string()))])
        store, _ = _store(self.path)
        rows = []
        for path, begin, end in partition.files:
            with store.open_input_file(path) as f:
                for line in _lines(f, begin, end):
                    if (row := _segment(line)) and self.holds(row):
                        rows.append(row)
                        if len(rows) == LINES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)


def _lines(f: pa.NativeFile, begin: int, end: int) -> Iterator[str]:
    f.seek(max(begin - 1, 0))
    b = io.BufferedReader(f, 1 << 20)
    at = begin - 1 + len(b.readline()) if begin else 0
    while at < end and (line := b.readline()):
        at += len(line)
        yield line.decode("utf-8", "replace")


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _segment(line: str) -> dict | None:
    """A row of a segment list; None for comments, blank lines and fewer than four fields."""
    if line.startswith("#") or not line.strip():
        return None
    fields = next(csv.reader([line.rstrip("\r\n")], skipinitialspace=True), [])
    if len(fields) < 4 or not fields[3]:
        return None
    return {"ytid": fields[0] or None, "start": _number(fields[1]), "end": _number(fields[2]), "mids": [m.strip(" ") for m in fields[3].split(",")]}


class WavReader(_Reader):
    """Filters on the path hold before a file is opened."""

    columns = ("path",)

    def partitions(self):
        parts, now, total = [], [], 0
        for path, n in _listed(self.path, ".wav"):
            if self.holds({"path": path}):
                if now and total + n > self.size:
                    parts.append(Part(now))
                    now, total = [], 0
                now.append((path, 0, n))
                total += n
        return [*parts, Part(now)]

    def read(self, partition):
        schema = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
        store, _ = _store(self.path)
        for path, _, _ in partition.files:
            with store.open_input_file(path) as f:
                samples, error = samples_at(f.read(), self.rate)
            yield pa.RecordBatch.from_pylist([{"path": path, "rate": self.rate, "samples": samples, "error": error}], schema)


class Segments(D.DataSource):
    """Options: path, partitionBytes."""

    @classmethod
    def name(cls):
        return "segments"

    def schema(self):
        return "ytid string, start double, end double, mids array<string>"

    def reader(self, schema):
        return SegmentsReader(self.options)


class Wav(D.DataSource):
    """Options: path, rate (others are interpolated), partitionBytes. What isn't 16-bit PCM has an error."""

    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return "path string, rate int, samples array<float>, error string"

    def reader(self, schema):
        return WavReader(self.options)


def register(spark: SparkSession) -> None:
    """Both formats in this session, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Segments, Wav):
        spark.dataSource.register(source)

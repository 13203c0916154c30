"""Folders of files as a data source that lists first, and reads what is wanted in even parts.

The driver lists names, sizes and times.  Filters on them drop files before any
is opened, and the rest are packed into partitions by size, so that a few large
files and very many small ones make tasks of about the same length.
"""

from __future__ import annotations

import heapq
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from leafmill.sinks.files import file_system

#: Bytes of a partition, and what opening a file costs in bytes.
PARTITION, OPENING = 128 << 20, 64 << 10
#: Bytes of contents in a batch.
BATCH = 16 << 20
SCHEMA = "path string, extension string, modificationTime timestamp, length long, content binary"


@dataclass
class Files(ds.InputPartition):
    """Files (path, extension, time, length) of one task."""

    files: list[tuple] = field(default_factory=list)


def packed(files: list[tuple], partition: int = PARTITION) -> list[Files]:
    """``files`` in as many parts as their bytes need, each file, largest first, into the part that has least."""
    cost = lambda f: f[3] + OPENING
    total = sum(map(cost, files))
    parts = [Files() for _ in range(max(1, min(len(files), -(-total // partition))))]
    heap = [(0, i) for i in range(len(parts))]
    for f in sorted(files, key=lambda f: (-f[3], f[0])):
        load, i = heapq.heappop(heap)
        parts[i].files.append(f)
        heapq.heappush(heap, (load + cost(f), i))
    return parts


#: Whether a value passes a pushed filter, by the filter's class.
TESTS = {
    ds.EqualTo: lambda v, x: v == x, ds.In: lambda v, x: v in x, ds.GreaterThan: lambda v, x: v > x, ds.GreaterThanOrEqual: lambda v, x: v >= x, ds.LessThan: lambda v, x: v < x,
    ds.LessThanOrEqual: lambda v, x: v <= x, ds.StringStartsWith: lambda v, x: v.startswith(x), ds.StringEndsWith: lambda v, x: v.endswith(x), ds.StringContains: lambda v, x: x in v,
}
PLACES = {"path": 0, "extension": 1, "length": 3}


class ScanReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.contents = options["path"], options.get("contents", "true").lower() == "true"
        self.partition = int(options.get("partitionBytes", PARTITION))
        self.kept: list[tuple] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes comparisons of path, extension and length with values; the rest goes back to Spark."""
        for f in filters:
            negated = isinstance(f, ds.Not)
            inner = f.child if negated else f
            test, name = TESTS.get(type(inner)), ".".join(getattr(inner, "attribute", ()))
            if isinstance(inner, ds.IsNotNull) and not negated and name in PLACES:
                continue  # these are never null
            if test is None or name not in PLACES:
                yield f
            else:
                self.kept.append((PLACES[name], test, inner.value, negated))

    def listed(self) -> list[tuple]:
        fs, root = file_system(self.root)
        prefix = self.root[: -len(root)] if self.root.rstrip("/").endswith(root) else ""
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        rows = []
        for f in found:
            below = f.path[len(root) :].split("/")
            if f.type != pafs.FileType.File or any(p.startswith(("_", ".")) for p in below):
                continue
            row = (prefix + f.path, posixpath.splitext(f.path)[1].lower(), f.mtime, f.size)
            if all(test(row[k], value) != negated for k, test, value, negated in self.kept):
                rows.append(row)
        return rows

    def partitions(self) -> list[Files]:
        return packed(self.listed(), self.partition if self.contents else 1 << 62)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, extension, time, length in partition.files:
            content = None
            if self.contents:
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as f:
                    content = f.read()
            rows.append((path, extension, time, length, content))
            held += len(content or b"") + 1000
            if held >= BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "extension", "modificationTime", "length", "content"])


class DocumentScan(ds.DataSource):
    """``spark.read.format("document_scan").option("contents", ...).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "document_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ScanReader:
        return ScanReader(self.options)


def read(spark: SparkSession, folder: str, contents: bool = True, partition: int = PARTITION) -> DataFrame:
    """(path, extension, modificationTime, length, content) of the files under a folder, or of one file.

    Names that begin with ``_`` or ``.`` are left out, at any depth; extension is
    in lower case, empty for none.  Without ``contents`` no file is opened and
    content is null.  Filters on path, extension and length are applied to the
    listing.  A folder that isn't there has no files.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(DocumentScan)
    return spark.read.format("document_scan").option("contents", contents).option("partitionBytes", partition).load(folder)

"""Rows that readers make of files, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
#: Rows of a batch.
ROWS = 1000


def by_file(files: DataFrame, schema: str, work: Callable[[str, bytes], Iterable[tuple]]) -> DataFrame:
    """The rows that ``work`` (path, bytes) gives for each of ``files`` (path, content); a null content counts as empty."""
    fields = [c.split(None, 1) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*held, strict=True) if held else [()] * len(fields)
            out = pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
            held.clear()
            return out

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for row in work(path, content or b""):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield flush()
        yield flush()

    return files.select("path", "content").mapInArrow(run, schema)

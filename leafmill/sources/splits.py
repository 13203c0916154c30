"""Delimited files cut by bytes, quoted line ends and all.

Where a record ends depends on every quote before it.  A piece of a file is
summarised for each state it may begin in: the state that it ends in, and how
many records begin in it.  Such summaries combine from left to right, so one pass
over all pieces in parallel and a scan over their summaries give each piece its
true state and the number of its first record.  A second pass then reads the
records that begin in a piece, beyond its end where the last one goes on.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sinks.files import file_system
from leafmill.sinks.shared import durable
from leafmill.sources.files import SAMPLE, sniff

#: Bytes of a piece, and pieces of a file whose summaries are combined in one group.
PIECE, GROUP = 32 << 20, 1024
#: States: a record begins, a field begins, within a plain field, within quotes, after a quote within quotes.
RECORD, FIELD, PLAIN, QUOTED, CLOSED = range(5)
OTHER, QUOTE, SEPARATOR, END = range(4)
#: The next state by state and kind of byte.
NEXT = np.array(
    [
        [PLAIN, QUOTED, FIELD, RECORD],
        [PLAIN, QUOTED, FIELD, RECORD],
        [PLAIN, PLAIN, FIELD, RECORD],
        [QUOTED, CLOSED, QUOTED, QUOTED],
        [PLAIN, QUOTED, FIELD, RECORD],
    ],
    "u1",
)
#: Bytes that are worked on side by side.
LANES = 4096


def kinds(data: bytes, delimiter: str) -> np.ndarray:
    table = np.zeros(256, "u1")
    table[[10, 13]], table[34], table[ord(delimiter)] = END, QUOTE, SEPARATOR
    return table[np.frombuffer(data, "u1")]


def _lanes(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as rows of equal length that are walked in step, and the rest."""
    width = len(kind) // LANES
    return kind[: width * LANES].reshape(LANES, width), kind[width * LANES :]


def summary(kind: np.ndarray) -> tuple[list[int], list[int]]:
    """For each state before the bytes: the state after them, and the records that begin in them."""
    lanes, rest = _lanes(kind)
    state = np.repeat(np.arange(5, dtype="u1")[:, None], len(lanes), 1)
    begun = np.zeros(state.shape, "i8")
    for column in np.ascontiguousarray(lanes.T):
        begun += (state == RECORD) & (column != END)
        state = NEXT[state, column]
    out, count = np.arange(5), np.zeros(5, "i8")
    for i in range(len(lanes)):
        count += begun[out, i]
        out = state[out, i]
    for k in rest:
        count += (out == RECORD) & (k != END)
        out = NEXT[out, k]
    return out.tolist(), count.tolist()


def begins(kind: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Places of the bytes at which records begin, and the state after the last byte."""
    lanes, rest = _lanes(kind)
    width = lanes.shape[1]
    entry = np.repeat(np.arange(5, dtype="u1")[:, None], len(lanes), 1)
    for column in np.ascontiguousarray(lanes.T):
        entry = NEXT[entry, column]
    first = np.zeros(len(lanes), "u1")
    for i in range(len(lanes)):
        first[i] = state
        state = int(entry[state, i])
    found, now = [], first
    for t, column in enumerate(np.ascontiguousarray(lanes.T)):
        at = np.flatnonzero((now == RECORD) & (column != END))
        if len(at):
            found.append(at * width + t)
        now = NEXT[now, column]
    for t, k in enumerate(rest.tolist()):
        if state == RECORD and k != END:
            found.append(np.array([width * LANES + t]))
        state = int(NEXT[state, k])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, "i8"), state


def combined(rows: list[dict]) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """The summary of pieces in order, and for each start state 0 what lies before each: (state, records)."""
    state, count = list(range(5)), [0] * 5
    before = []
    for r in rows:
        before.append((list(state), list(count)))
        count = [c + r["count"][s] for c, s in zip(count, state, strict=True)]
        state = [r["next"][s] for s in state]
    return state, count, before


@dataclass
class Reader:
    """How pieces of one kind of file are read."""

    delimiter: str | None
    encoding: str | None

    def delimiter_of(self, fs, path: str) -> str:
        if self.delimiter:
            return self.delimiter
        with fs.open_input_file(path) as f:
            return sniff(f.read(SAMPLE).decode("utf-8", "replace")) or ","

    def summarise(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path = file_system(r["path"])
                delimiter = self.delimiter_of(fs, path)
                with fs.open_input_file(path) as f:
                    f.seek(r["start"])
                    data = f.read(r["end"] - r["start"])
                after, count = summary(kinds(data, delimiter))
                yield batch(PIECES, path=[r["path"]], piece=[r["piece"]], start=[r["start"]], end=[r["end"]], next=[after], count=[count], utf8=[is_utf8(data)], delimiter=[delimiter])

    def records(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            for r in b.to_pylist():
                fs, path = file_system(r["path"])
                encoding = self.encoding or ("utf-8" if r["utf8"] else "latin-1")
                with fs.open_input_file(path) as f:
                    f.seek(r["start"])
                    data = f.read(r["end"] - r["start"])
                    places, state = begins(kinds(data, r["delimiter"]), r["state"])
                    if not len(places):
                        continue
                    while state != RECORD and (more := f.read(1 << 16)):  # the last record goes on in the next piece
                        kind = kinds(more, r["delimiter"])
                        for t, k in enumerate(kind.tolist()):
                            state = int(NEXT[state, k])
                            if state == RECORD:
                                more = more[: t + 1]
                                break
                        data += more
                text = data[int(places[0]) :].decode(encoding, "replace")
                if r["start"] == 0 and int(places[0]) == 0:
                    text = text.removeprefix("﻿")
                rows: list[list[str]] = []
                number = r["first"]
                for cells in csv.reader(io.StringIO(text, newline=""), delimiter=r["delimiter"]):
                    if cells:
                        rows.append(cells)
                    if len(rows) == 2000:
                        yield self._rows(r["path"], number, rows)
                        number, rows = number + len(rows), []
                if rows:
                    yield self._rows(r["path"], number, rows)

    @staticmethod
    def _rows(path: str, number: int, rows: list[list[str]]) -> pa.RecordBatch:
        return batch(ROWS, path=[path] * len(rows), row_no=list(range(number, number + len(rows))), cells=rows)


LONGS = pa.list_(pa.int64())
PIECES = {"path": pa.string(), "piece": pa.int64(), "start": pa.int64(), "end": pa.int64(), "next": LONGS, "count": LONGS, "utf8": pa.bool_(), "delimiter": pa.string()}
ROWS = {"path": pa.string(), "row_no": pa.int64(), "cells": pa.list_(pa.string())}


def batch(types: dict[str, pa.DataType], **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in types.items()], names=list(types))


def is_utf8(data: bytes) -> bool:
    """Whether bytes may be a part of UTF-8: a sign that is cut at either end doesn't count against it."""
    begin = next((i for i in range(min(4, len(data))) if data[i] & 0xC0 != 0x80), 0)
    for cut in range(4):
        try:
            data[begin : len(data) - cut].decode("utf-8")
        except UnicodeDecodeError as e:
            if e.reason != "unexpected end of data":
                return False
            continue
        return True
    return False


def _scan(pieces: DataFrame) -> DataFrame:
    """``pieces`` with (state, first): the state that each begins in and the number of its first record.

    Summaries are combined in groups of ``GROUP`` neighbours, then those of the
    groups of a file, so the rows that meet in one task are the square root of a
    large file's pieces or so.
    """

    def of_group(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        after, count, _ = combined(rows)
        return pa.Table.from_batches([batch(SUMS, path=[rows[0]["path"]], group=[rows[0]["group"]], next=[after], count=[count])])

    def of_file(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["group"])
        _, _, before = combined(rows)
        return pa.Table.from_batches([batch(STARTS, path=[r["path"] for r in rows], group=[r["group"] for r in rows], g_state=[s[RECORD] for s, _ in before], g_first=[c[RECORD] for _, c in before])])

    def within(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        _, _, before = combined(rows)
        state, first = rows[0]["g_state"], rows[0]["g_first"]
        found = [{"state": s[state], "first": first + c[state]} for s, c in before]
        return pa.Table.from_batches([batch(PLACED, **{n: [(r | f)[n] for r, f in zip(rows, found, strict=True)] for n in PLACED})])

    grouped = pieces.withColumn("group", F.floor(F.col("piece") / GROUP))
    sums = grouped.groupBy("path", "group").applyInArrow(of_group, "path string, group long, next array<long>, count array<long>")
    starts = sums.groupBy("path").applyInArrow(of_file, "path string, group long, g_state long, g_first long")
    utf8 = pieces.groupBy("path").agg(F.bool_and("utf8").alias("all_utf8"))
    joined = grouped.join(starts, ["path", "group"]).join(utf8, "path").drop("utf8").withColumnRenamed("all_utf8", "utf8")
    return joined.groupBy("path", "group").applyInArrow(within, "path string, start long, end long, utf8 boolean, delimiter string, state long, first long")


SUMS = {"path": pa.string(), "group": pa.int64(), "next": LONGS, "count": LONGS}
STARTS = {"path": pa.string(), "group": pa.int64(), "g_state": pa.int64(), "g_first": pa.int64()}
PLACED = {"path": pa.string(), "start": pa.int64(), "end": pa.int64(), "utf8": pa.bool_(), "delimiter": pa.string(), "state": pa.int64(), "first": pa.int64()}


def read_rows(spark: SparkSession, path: str, *, delimiter: str | None = None, encoding: str | None = None, piece: int = PIECE) -> DataFrame:
    """(path, row_no, cells) of a delimited file or of all files under a folder; row_no 0 is the header, blank lines go.

    Each file has its own delimiter, sniffed from its beginning, and encoding:
    UTF-8 if all of it is, else Latin-1.  A file of any size is cut into pieces
    of ``piece`` bytes; a record is held whole by one task.  A quote opens a
    field only where the field begins, two within quotes are one.  An empty file has no
    rows.
    """
    reader = Reader(delimiter, {"UTF-8": "utf-8", "ISO-8859-1": "latin-1"}.get(encoding or "", encoding))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path", "length")
    plan = found.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / piece))).alias("piece"))
    plan = plan.select("path", "piece", (F.col("piece") * piece).alias("start"), F.least("length", (F.col("piece") + 1) * piece).alias("end"))
    spread = plan.repartition(max(1, min(20_000, plan.count())), "path", "piece")
    told = spread.mapInArrow(reader.summarise, "path string, piece long, start long, end long, next array<long>, count array<long>, utf8 boolean, delimiter string")
    pieces = durable(told, "pieces")
    placed = durable(_scan(pieces), "placed")
    n = max(1, min(20_000, placed.count()))
    return placed.repartition(n, "path", "start").mapInArrow(reader.records, "path string, row_no long, cells array<string>")

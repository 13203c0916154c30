"""Counters of a stream that outlive it, and how far it is."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from leafmill.sinks.files import file_system

#: Fraction that can't be told.
UNKNOWN = -1.0
NAMES = ("completed", "failed", "sections")


class Counters:
    """Sums over all batches, one small file for each of the last two batches.

    A batch adds what it observed to the sums of the batch before and puts the
    result beside the output; running again it replaces its own file.  Nothing is
    read but that file, however long the stream has run.
    """

    def __init__(self, folder: str) -> None:
        self.fs, inner = file_system(folder)
        self.folder = f"{inner}/_counters"

    def _numbers(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def _read(self, number: int) -> dict[str, int]:
        with self.fs.open_input_file(f"{self.folder}/{number}.json") as f:
            return json.loads(f.read())

    def totals(self) -> dict[str, int]:
        """The sums as of the last batch; zeros before the first."""
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else dict.fromkeys(NAMES, 0)

    def add(self, number: int, seen: dict[str, int]) -> dict[str, int]:
        before = [n for n in self._numbers() if n < number]
        sums = self._read(before[-1]) if before else dict.fromkeys(NAMES, 0)
        sums = {k: sums.get(k, 0) + int(seen.get(k) or 0) for k in NAMES}
        self.fs.create_dir(self.folder)
        part, path = f"{self.folder}/{number}.part", f"{self.folder}/{number}.json"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(sums).encode())
        if self.fs.get_file_info(path).type == pafs.FileType.File:
            self.fs.delete_file(path)
        self.fs.move(part, path)
        for old in before[:-1]:
            self.fs.delete_file(f"{self.folder}/{old}.json")
        return sums


def observed(sections: DataFrame) -> tuple[DataFrame, Observation]:
    """``sections`` whose files and rows are counted while they are written."""
    seen = Observation()
    first = F.coalesce(F.col("sec_no"), F.lit(0)) == 0
    return sections.observe(
        seen, F.count_if((F.col("status") != "failed") & first).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") != "failed").alias("sections")
    ), seen


def blended(index: Column, part: Column, total: Column) -> Column:
    """Fraction of a batch from the number of files done before, the fraction of the present file and the number of files; -1 where one can't be told."""
    known = (part >= 0) & (total > 0)
    return F.when(known, (index + F.least(part, F.lit(1.0))) / total).otherwise(F.lit(UNKNOWN))


class Progress(StreamingQueryListener):
    """How far the streams of a session are: files read, and the fraction of those that are known.

    The source tells how many files still wait; with those that were read this
    gives the fraction, ``UNKNOWN`` where the source doesn't tell.  ``on`` is
    called with (query id, files, fraction) after every batch.
    """

    def __init__(self, on: Callable[[str, int, float], None] | None = None) -> None:
        self.on, self.files, self.fractions, self.failures = on, {}, {}, {}

    def onQueryStarted(self, event) -> None:
        self.files.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p, name = event.progress, str(event.progress.id)
        self.files[name] = self.files.get(name, 0) + p.numInputRows
        waiting = [s.metrics.get("numFilesOutstanding") for s in p.sources if s.metrics]
        total = self.files[name] + sum(int(w) for w in waiting if w is not None)
        self.fractions[name] = self.files[name] / total if waiting and None not in waiting and total else UNKNOWN
        if self.on:
            self.on(name, self.files[name], self.fractions[name])

    def onQueryIdle(self, event) -> None:
        self.fractions[str(event.id)] = 1.0

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures[str(event.id)] = event.exception


def stop_when_idle(query: StreamingQuery, every: float = 0.2) -> threading.Thread:
    """Ends a stream with timers after a batch without rows that leaves no state: all that was there has settled."""

    def wait() -> None:
        while query.isActive:
            last = query.lastProgress
            if last and last["numInputRows"] == 0 and last["stateOperators"] and not any(o["numRowsTotal"] for o in last["stateOperators"]):
                query.stop()
                return
            query.awaitTermination(every)

    thread = threading.Thread(target=wait, daemon=True)
    thread.start()
    return thread

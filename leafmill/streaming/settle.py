"""Files that are still being written, as keyed state with timers.

A file is whole when two looks in a row find the same size, over zero.  Paths are
spread over shards; a shard keeps the size and the number of looks of each of its
open paths, and how many these are, so that the queue has a bound without a
global counter.  Nothing waits: a path that grows is looked at again when its
shard's timer fires, and others go on.  State is in the checkpoint, so a restart
goes on with the looks that were made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmill.sinks.files import file_system

# Seconds between looks, how many there are, and files that may be open at a time.
EVERY, LOOKS, OPEN = 1.5, 20, 500
OUTCOME = "path string, status string, size long, looks int"
COLUMNS = ["path", "status", "size", "looks"]
#: Looks whose outcomes make one frame.
ROWS = 100_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def size_of(path: str) -> int | None:
    """Bytes of a file, None if it is gone."""
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    return info.size if info.type == pafs.FileType.File else None


class Settle(StatefulProcessor):
    """Looks at paths: given as frames (path, size, ord) in order of ord, or made by itself every so many seconds."""

    def __init__(self, looks: int, most: int | None, every: float | None, measure: Callable[[str], int | None] = size_of) -> None:
        self.looks, self.most, self.every, self.measure = looks, most, every, measure

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "path string", "size long, looks int")
        self.n = handle.getValueState("n", "n long")

    def _look(self, known: tuple[int, int], size: int) -> tuple[str | None, int]:
        """One look: what became of a path (None while it stays open) by its last size and its looks, and the looks."""
        last, looks = known
        status = "whole" if size == last and size > 0 else "unfinished" if looks + 1 >= self.looks else None
        return status, looks + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows wait as numbers; of each path, state is read once and written once a batch.
        names: dict[str, int] = {}
        parts: list[np.ndarray] = []
        for frame in rows:
            numbers = [names.setdefault(p, len(names)) for p in frame["path"]]
            parts.append(np.stack([np.array(numbers, "i8"), frame["size"].to_numpy("i8"), frame["ord"].to_numpy("i8")]))
        at, sizes, order = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), "i8")
        paths = list(names)
        rank = np.empty(len(paths), "i8")
        rank[sorted(range(len(paths)), key=paths.__getitem__)] = np.arange(len(paths))
        sort = np.lexsort((rank[at], order))
        held = self.open.exists()
        before = [self.open.getValue((p,)) if held else None for p in paths]
        now, count = list(before), (self.n.get()[0] if self.n.exists() else 0)
        out: list[tuple] = []
        for i in range(0, len(sort), ROWS):
            for k, size in zip(at[sort[i : i + ROWS]].tolist(), sizes[sort[i : i + ROWS]].tolist(), strict=True):
                known = now[k]
                if known is None:
                    if self.most is not None and count >= self.most:
                        out.append((paths[k], "refused", size, 0))
                        continue
                    count += 1
                    known = (-1, 0)
                elif self.every:
                    continue  # counts once while it is open
                status, looks = self._look(known, size)
                if status is None:
                    now[k] = (size, looks)
                else:
                    now[k], count = None, count - 1
                    out.append((paths[k], status, size, looks))
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        for p, old, new in zip(paths, before, now, strict=True):
            if new is not None and new != old:
                self.open.updateValue((p,), new)
            elif new is None and old is not None:
                self.open.removeKey((p,))
        self._count(count)
        self._again(timerValues)

    def _count(self, n: int) -> None:
        if n:
            self.n.update((n,))
        elif self.n.exists():
            self.n.clear()  # an idle shard leaves no state, by which a stream that runs once knows its end

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, count = [], self.n.get()[0] if self.n.exists() else 0
        for path in [k[0] for k in self.open.keys()]:  # noqa: SIM118
            size, known = self.measure(path), self.open.getValue((path,))
            status, looks = self._look(known, size) if size is not None else ("gone", known[1])
            if status is None:
                self.open.updateValue((path,), (size, looks))
            else:
                self.open.removeKey((path,))
                count -= 1
                out.append((path, status, size, looks))
        self._count(count)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS).astype({"size": "Int64"})
        self._again(timerValues)

    def _again(self, timers) -> None:
        if self.every and self.n.exists() and self.n.get()[0] > 0 and not any(t > timers.getCurrentProcessingTimeInMs() for t in self.handle.listTimers()):
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.every * 1000))

    def close(self) -> None:
        pass


def settled(files: DataFrame, *, every: float | None = EVERY, looks: int = LOOKS, most: int | None = OPEN, shards: int = 16) -> DataFrame:
    """(path, status, size, looks): what becomes of each path of a stream ``files`` (path, size, ord).

    status is ``whole`` after two looks that found the same size over zero,
    ``unfinished`` after ``looks`` looks, ``gone`` if the file went away, and
    ``refused`` while its shard has its share of ``most`` open paths.  With
    ``every`` the first look is the row's and later ones are taken that many
    seconds apart; without it each row is a look, in order of ord within a
    batch.  A path that has settled may come again.  Null paths and sizes are left out.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    share = None if most is None else max(1, most // shards)
    rows = files.where("path IS NOT NULL AND size IS NOT NULL").select("path", F.col("size").cast("long").alias("size"), F.col("ord").cast("long").alias("ord"))
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").transformWithStateInPandas(Settle(looks, share, every), OUTCOME, "append", "processingTime" if every else "none")

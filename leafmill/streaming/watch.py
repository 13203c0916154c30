"""A watched folder as a stream: arriving files are read once and converted batch by batch."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions.text import extension
from leafmill.operators.assets import normal_path
from leafmill.sinks.files import file_system
from leafmill.sinks.shared import durable, forget
from leafmill.sources.files import supported
from leafmill.sources.office import read_sections
from leafmill.streaming.counters import Counters, observed, stop_when_idle
from leafmill.streaming.settle import LOOKS, OPEN, settled

# Fixed value: files of a batch.
PER_BATCH = 500
FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, since: str | None = None, per_batch: int = PER_BATCH, output: str | None = None, empty: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of supported files as they arrive, empty ones only if asked for.

    Files older than ``since`` are left out, and those under ``output``, which
    would feed themselves.  A batch holds ``per_batch`` files; more wait for the next.
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder)
    stream = stream.where(supported(F.col("path")) & ((F.col("length") > 0) | F.lit(empty)))
    if output:
        plain = lambda c: normal_path(F.regexp_replace(c, "^file:", ""))
        stream = stream.where(~F.startswith(plain(F.col("path")), F.concat(plain(F.lit(output)), F.lit("/"))))
    return stream.where(F.col("modificationTime") >= F.lit(since).cast("timestamp")) if since else stream


def plain_path(path: str) -> str:
    """A path without its scheme if that is ``file``, absolute if it is local, and normalised; other schemes stay."""
    scheme, _, rest = path.partition(":") if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path) else ("file", "", path)
    if scheme.lower() != "file":
        host, _, inner = rest.lstrip("/").partition("/")
        return f"{scheme.lower()}://{host.lower()}{posixpath.normpath('/' + inner)}"
    return os.path.realpath(re.sub("^/+", "/", rest.replace("\\", "/")))


def guard(watched: str, output: str) -> None:
    """An output that is the watched folder or lies in it would feed itself, however the two are written."""
    if (plain_path(output).rstrip("/") + "/").startswith(plain_path(watched).rstrip("/") + "/"):
        raise ValueError("the output folder must not be inside the watched folder")


def once_each(files: DataFrame, late: str = "30 days", path: str = "path", modified: str = "modificationTime") -> DataFrame:
    """A stream of files with each path once for each time of modification: an unchanged file isn't read again, a changed one is.

    What is known of a file is forgotten once the watermark, ``late`` behind the
    newest time seen, has passed it, so the state has a bound; rows that are later
    than that are left out.  Rows without a path or time are left out.
    """
    return files.where(F.col(path).isNotNull() & F.col(modified).isNotNull()).withWatermark(modified, late).dropDuplicatesWithinWatermark([path, modified])


def read_paths(paths: DataFrame) -> DataFrame:
    """(path, content) of ``paths`` (path), read by the tasks; a file that is gone gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, inner = file_system(path)
                try:
                    with fs.open_input_file(inner) as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    return paths.select("path").mapInArrow(run, "path string, content binary")


def watch(
    spark: SparkSession, folder: str, output: str, checkpoint: str, *, convert: Callable[[DataFrame], DataFrame] = read_sections, once: bool = False, every: str = "2 seconds",
    settle: float = 0.0, looks: int = LOOKS, most: int | None = OPEN, **options,
) -> StreamingQuery:
    """Convert arriving files to sections under ``output``; the checkpoint keeps each file from being read twice.

    Batches are written under their number, so a batch that runs again replaces
    what it wrote before.  With ``settle``, files are looked at that many seconds
    apart until they stop growing, by keyed state (see ``settle``): one that
    grows for ``looks`` looks, or comes while ``most`` are open, is reported as
    failed, and none holds up another.  ``Counters(output).totals()`` tells how
    many files were completed and failed.  ``once`` ends when all that was there
    has been read and has settled.
    """
    guard(folder, output)
    counters = Counters(output)

    def keep(out: DataFrame, number: int) -> None:
        out, seen = observed(out)
        out.write.mode("overwrite").parquet(f"{output}/batch={number}")
        counters.add(number, seen.get)

    def batch(files: DataFrame, number: int) -> None:
        keep(convert(files), number)

    def outcomes(rows: DataFrame, number: int) -> None:
        events = durable(rows, "outcomes")  # the stateful plan runs once
        reason = F.when(F.col("status") == "unfinished", "file never stopped growing").when(F.col("status") == "refused", "too many files are being written")
        bad = events.where(F.col("status").isin("unfinished", "refused")).select("path", F.lit("failed").alias("status"), reason.alias("error"))
        whole = events.where("status = 'whole'").select("path").repartition("path")
        keep(convert(read_paths(whole)).unionByName(bad, allowMissingColumns=True), number)
        forget(events)

    files = arrivals(spark, folder, output=output, empty=bool(settle), **options)
    if settle:
        looked = settled(files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("ord")), every=settle, looks=looks, most=most)
        query = looked.writeStream.foreachBatch(outcomes).option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if once else {"processingTime": every})).start()
        if once:
            stop_when_idle(query)
        return query
    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def progress(query: StreamingQuery) -> list[tuple[int, str, int, float]]:
    """(batch, started, files, files a second) of the last batches of a stream."""
    return [(p["batchId"], p["timestamp"], p["numInputRows"], p.get("processedRowsPerSecond") or 0.0) for p in query.recentProgress]


def totals(sections: DataFrame) -> DataFrame:
    """(extension, completed, failed): files by status."""
    files = sections.groupBy("path").agg(F.max((F.col("status") == "failed").cast("int")).alias("bad"))
    return files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count_if(F.col("bad") == 0).alias("completed"), F.count_if(F.col("bad") == 1).alias("failed"))

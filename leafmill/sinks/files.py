"""A sink that writes every row as a file of its own, at the row's path.

Tasks write into a folder of their attempt; nothing appears under its own path
until all tasks have succeeded.  The driver then moves the files of those
attempts that Spark counts, so a task that ran twice leaves one file, and a job
that fails leaves none.  What became of each row is kept as a table beside the
files, written and moved task by task: the driver holds the rows of a few tasks
at a time, never of the job.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Folders of unfinished attempts and of the tables of what was written; readers skip names with a leading underscore.
ATTEMPTS, WRITTEN = "_attempts", "_written"
REPORT = pa.schema([("path", pa.string()), ("status", pa.string()), ("bytes", pa.int64()), ("reason", pa.string()), ("staged", pa.string())])
#: Threads of the driver that move files.
MOVERS = 16
#: Rows of a report that a mover holds at a time, and bytes of contents in a batch that is read back.
ROWS, BATCH = 2000, 16 << 20


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path within it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
    return fs, path.rstrip("/")


def inner_path(path: str | None) -> str | None:
    """A path below the root, normalised; None for none at all and for one that leads outside or into the sink's own folders."""
    plain = posixpath.normpath((path or "").replace("\\", "/").lstrip("/"))
    outside = plain in ("", ".") or plain.split("/")[0] in ("..", ATTEMPTS, WRITTEN) or "\0" in plain
    return None if outside else plain


@dataclass
class Attempt(WriterCommitMessage):
    """A task's folder within that of the job."""

    folder: str


class FileWriter(DataSourceArrowWriter):
    """Writes rows (path, text or content); other columns are left out."""

    def __init__(self, root: str, overwrite: bool, job: str) -> None:
        self.root, self.overwrite, self.job = root, overwrite, job

    def _folder(self, *more: str) -> str:
        return "/".join([file_system(self.root)[1], ATTEMPTS, self.job, *more])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, root = file_system(self.root)
        attempt, rows = uuid.uuid4().hex, []
        folder = self._folder(attempt)
        fs.create_dir(folder)
        for batch in iterator:
            data = batch.column("content" if "content" in batch.schema.names else "text").cast(pa.large_binary())
            for path, content in zip(batch.column("path"), data, strict=True):
                path, content = path.as_py(), content.as_py() or b""
                inner = inner_path(path)
                if inner is None:
                    rows.append((path, "refused", len(content), "not a path below the root", None))
                    continue
                try:
                    taken = not self.overwrite and fs.get_file_info(f"{root}/{inner}").type != pafs.FileType.NotFound
                except OSError as e:
                    rows.append((inner, "failed", len(content), str(e), None))
                    continue
                if taken:
                    rows.append((inner, "exists", len(content), None, None))
                else:
                    name = f"{len(rows):09d}"
                    with fs.open_output_stream(f"{folder}/{name}") as out:
                        out.write(content)
                    rows.append((inner, "written", len(content), None, name))
        self._report(fs, f"{folder}/report.parquet", rows)
        return Attempt(attempt)

    @staticmethod
    def _table(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(REPORT), REPORT, strict=True)], schema=REPORT)

    @classmethod
    def _report(cls, fs: pafs.FileSystem, path: str, rows: list[tuple]) -> None:
        table = cls._table(rows)
        with fs.open_output_stream(path) as out:
            pq.write_table(table, out, row_group_size=ROWS)

    def _publish(self, attempt: str) -> None:
        """Moves the files of one task to their paths, and keeps its report; both a few rows at a time."""
        fs, root = file_system(self.root)
        folder = self._folder(attempt)
        fs.create_dir(f"{root}/{WRITTEN}/job={self.job}")
        with fs.open_input_file(f"{folder}/report.parquet") as held, fs.open_output_stream(f"{root}/{WRITTEN}/job={self.job}/{attempt}.parquet") as out, pq.ParquetWriter(out, REPORT) as report:
            for staged in pq.ParquetFile(held).iter_batches(ROWS):
                report.write_table(self._table([self._move(fs, root, folder, r) for r in staged.to_pylist()]))

    def _move(self, fs: pafs.FileSystem, root: str, folder: str, r: dict) -> tuple:
        status, reason = r["status"], r["reason"]
        if status == "written":
            target = f"{root}/{r['path']}"
            try:
                there = fs.get_file_info(target).type
                if there != pafs.FileType.NotFound and not (self.overwrite and there == pafs.FileType.File):
                    status = "exists"
                else:
                    fs.create_dir(posixpath.dirname(target))
                    if there == pafs.FileType.File:
                        fs.delete_file(target)
                    fs.move(f"{folder}/{r['staged']}", target)
            except OSError as e:
                status, reason = "failed", str(e)
        return r["path"], status, r["bytes"], reason, None

    def commit(self, messages: list[Attempt | None]) -> None:
        with ThreadPoolExecutor(MOVERS) as pool:
            for _ in pool.map(self._publish, [m.folder for m in messages if m]):
                pass
        self.abort(messages)

    def abort(self, messages: list[Attempt | None]) -> None:
        """Drops what attempts have left, those of failed tasks included."""
        fs, _ = file_system(self.root)
        if fs.get_file_info(self._folder()).type == pafs.FileType.Directory:
            fs.delete_dir(self._folder())
        parent = posixpath.dirname(self._folder())
        if fs.get_file_info(parent).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(parent)):
            fs.delete_dir(parent)


class DocumentFiles(DataSource):
    """``df.write.format("document_files").option("overwrite", ...).mode("append").save(root)``."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if "path" not in schema.names or not {"text", "content"} & set(schema.names):
            raise ValueError("rows need a path, and a text or a content")
        replace = overwrite or self.options.get("overwrite", "false").lower() == "true"
        return FileWriter(self.options["path"], replace, self.options.get("job") or uuid.uuid4().hex)


def write_files(rows: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """Writes ``rows`` (path, and text or content) as files under ``root``; returns (path, status, bytes, reason), a row for each.

    status is ``written``; ``exists`` for a path that is taken, whose file is
    left as it is unless ``overwrite``; ``refused`` for a null or empty path and
    one that leads out of ``root``; ``failed`` with the reason where the file
    system refuses the path.  A null text gives an empty file.  Of several rows of one path one is
    written and the others are ``exists``; with ``overwrite`` each replaces the
    one before in no fixed order.  No rows leave no files and an empty report.
    """
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(DocumentFiles)
    content = "content" if "content" in rows.columns else "text"
    rows.select("path", content).write.format("document_files").option("overwrite", overwrite).option("job", job).mode("append").save(root)
    return spark.read.schema("path string, status string, bytes long, reason string").parquet(f"{root.rstrip('/')}/{WRITTEN}/job={job}")


def written(spark: SparkSession, root: str) -> DataFrame:
    """(job, path, status, bytes, reason) of all that was written under ``root``, and of what was not."""
    return spark.read.schema("path string, status string, bytes long, reason string, job string").parquet(f"{root.rstrip('/')}/{WRITTEN}")


def read_back(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file that was written under ``root`` or was found there; path is that below ``root``.

    The paths are those of the reports, and tasks open the files: the driver lists
    none, however many there are.  A file that is gone gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(root)
        paths, contents, held = [], [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    with fs.open_input_file(f"{top}/{path}") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                paths.append(path)
                contents.append(content)
                held += len(content) + 1000
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                    paths, contents, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    there = written(spark, root).where(F.col("status").isin("written", "exists")).select("path").distinct()
    return there.mapInArrow(run, "path string, content binary")

"""Scans of folders, lists of files, and delimited text."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import base_name, extension
from leafmill.sources.rows import by_file

# Extensions of supported files, encodings of delimited text in the order in which they are tried, and delimiters.
EXTENSIONS = (
    ".pdf", ".docx", ".doc", ".rtf", ".xlsx", ".xls", ".csv", ".pptx", ".epub", ".dxf", ".html", ".htm",
    ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp", ".gif",
)
ENCODINGS, DELIMITERS = ("utf-8", "utf-8-sig", "latin-1", "cp1252"), (",", ";", "\t", "|")
SAMPLE = 8192


def supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def _glob() -> str:
    """A pattern for names of supported files, in upper and lower case."""
    either = lambda e: "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in e)
    return "*.{" + ",".join(either(e[1:]) for e in EXTENSIONS) + "}"


def scan(spark: SparkSession, *paths: str, contents: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of all supported files under folders, and of files given by name."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob()).load(list(paths))
    return df if contents else df.drop("content")


def listed(files: DataFrame, path: str = "path") -> DataFrame:
    """Files in order of their paths."""
    return files.orderBy(path)


def add_files(chosen: DataFrame, new: DataFrame) -> DataFrame:
    """(path, part, ord): chosen files (path, ord; part 0) and behind them new ones (part 1); of equal paths the first stays."""
    both = chosen.select("path", F.struct(F.lit(0).alias("part"), "ord").alias("at")).unionByName(new.select("path", F.struct(F.lit(1).alias("part"), "ord").alias("at")))
    return both.groupBy("path").agg(F.min("at").alias("at")).select("path", "at.*")


def not_listed(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Files of a folder that the list doesn't have."""
    return found.join(chosen.select("path").distinct(), "path", "left_anti")


def dropped_paths(text: Column) -> Column:
    """Paths of a dropped list, where braces hold paths with spaces."""
    found = F.regexp_extract_all(text, F.lit("(\\{[^}]*\\}|\\S+)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "^\\{|\\}$", ""))


def dropped(spark: SparkSession, text: str, contents: bool = True) -> DataFrame:
    """Supported files of a dropped list, folders walked."""
    paths = spark.range(1).select(dropped_paths(F.lit(text)).alias("p")).first()["p"]
    return scan(spark, *paths, contents=contents)


def texts(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".md", ".json", ".html", ".txt", ".jsonl")) -> DataFrame:
    """(path, name, text) of an output tree, for a preview or a validation."""
    df = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.where(extension(F.col("path")).isin(*extensions)).select("path", base_name(F.col("path")).alias("name"), "text")


def sniff(sample: str) -> str | None:
    """Delimiter of a sample, None if it can't be told."""
    try:
        return csv.Sniffer().sniff(sample, "".join(DELIMITERS)).delimiter
    except csv.Error:
        return None


def decoded(data: bytes) -> str:
    """Delimited text by the first encoding that fits; a byte order mark goes."""
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding).removeprefix("\ufeff")
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def csv_rows(data: bytes) -> list[list[str]]:
    """Rows of delimited text, by the sniffed delimiter or else the first one that parses; blank lines go."""
    text = decoded(data)
    guess = sniff(data[:SAMPLE].decode("utf-8", "replace"))
    for delimiter in dict.fromkeys([guess or ",", *DELIMITERS]):
        try:
            return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True) if r]
        except csv.Error:
            continue
    return [r for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline="")) if r]


def read_rows(files: DataFrame) -> DataFrame:
    """(path, row_no, cells) of delimited ``files`` (path, content), each by its own encoding and delimiter; row 0 is the header."""

    return by_file(files, "path string, row_no int, cells array<string>", lambda path, data: ((path, k, row) for k, row in enumerate(csv_rows(data))))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """A large delimited file or a folder of alike ones: all cells as strings, the first row of each file as its header.

    Files are cut by bytes, so one huge file is read by many tasks (see
    ``splits``); columns are named by the first file, missing cells are empty.
    """
    from leafmill.sources import splits

    rows = splits.read_rows(spark, path, delimiter=delimiter, encoding=encoding)
    head = rows.where("row_no = 0").orderBy("path").first()
    if head is None:
        return spark.createDataFrame([], "value string")
    names = [n or f"_c{i}" for i, n in enumerate(head["cells"])]
    return rows.where("row_no > 0").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")) for i in range(len(names))]).toDF(*names)


def sidecar_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_no, text): pages of a text parted by form feeds, from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\f", -1)).alias("p", "text")).select(key, (F.col("p") + 1).alias("page_no"), "text")

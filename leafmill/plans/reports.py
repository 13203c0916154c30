"""Reports of a batch: artifacts of each file, daily logs, results, and a view of what was processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import base_name, extension, safe_stem
from leafmill.operators.confidence import DIMENSIONS, badge, report, worst


def artifacts(results: DataFrame, logs: DataFrame, root: str, subfolder: bool = True) -> DataFrame:
    """(file, path, text): the confidence report and the log of each file, in its own folder; none where outputs share a folder.

    ``logs``: file, at, level, message.
    """
    if not subfolder:
        return results.limit(0).select("file", F.lit("").alias("path"), F.lit("").alias("text"))
    folder = F.concat(F.lit(root.rstrip("/") + "/"), safe_stem(F.col("file")), F.lit("/"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "level", "message"))), lambda x: F.format_string("%s [%s] %s", x["at"].cast("string"), x["level"], x["message"])), "\n")
    log = logs.groupBy("file").agg(F.concat(lines, F.lit("\n")).alias("text"))
    made = report(results).select("file", F.concat(folder, F.lit("confidence_report.txt")).alias("path"), F.col("report").alias("text"))
    return made.unionByName(results.select("file").join(log, "file").select("file", F.concat(folder, F.lit("conversion.log")).alias("path"), "text"))


def append_confidence(results: DataFrame, target: str, at: str = "at") -> None:
    """Reports appended to a log, in a folder for each day."""
    rows = report(results).join(results.select("file", at), "file")
    rows.select("file", at, "report", F.date_format(at, "yyyy-MM-dd").alias("day")).write.mode("append").partitionBy("day").parquet(target)


def append_log(rows: DataFrame, target: str) -> None:
    """Log lines (file, at, level, message) appended, in a folder for each day; old days are dropped as folders, which bounds its size."""
    rows.withColumn("day", F.date_format("at", "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(target)


def results(files: DataFrame, confidence: DataFrame, validated: DataFrame) -> DataFrame:
    """(file, name, extension, status, overall, badge, review, n_warnings, headings, words, grade_label): one line for each file of a batch.

    ``files`` (file, status), ``confidence`` (file, dimensions, manual_review_recommended,
    warnings), ``validated`` (file, heading_count, word_count, grade_label); a file
    that has none of the latter keeps its line.
    """
    c = confidence.select("file", worst(*[F.col(d) for d in DIMENSIONS]).alias("overall"), F.col("manual_review_recommended").alias("review"), F.size("warnings").alias("n_warnings"))
    out = files.join(c, "file", "left").join(validated.select("file", F.col("heading_count").alias("headings"), F.col("word_count").alias("words"), "grade_label"), "file", "left")
    overall = F.when(F.startswith("status", F.lit("failed")), "Failed").otherwise(F.coalesce("overall", F.lit("N/A")))
    return out.select(
        "file", base_name(F.col("file")).alias("name"), extension(F.col("file")).alias("extension"), "status", overall.alias("overall"), badge(overall).alias("badge"),
        F.coalesce("review", F.lit(False)).alias("review"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"), "headings", "words", "grade_label",
    )


def diagnostics(rows: DataFrame) -> DataFrame:
    """(extension, status, files, bytes, slowest): what a report on a run needs, from (file, status, length, seconds)."""
    return rows.groupBy(extension(F.col("file")).alias("extension"), "status").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("seconds").alias("slowest")
    )

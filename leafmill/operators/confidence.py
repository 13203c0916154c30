"""Confidence labels, their bands, and worst-of roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators import ordered

# Labels from worst to best, and dimensions.
LABELS = ("Failed", "Low", "Medium", "High")
DIMENSIONS = ("text_extraction", "table_structure", "image_extraction", "image_placement", "document_order", "ocr_confidence")


def rank(label: Column) -> Column:
    """0 to 3 from worst to best, null for N/A, 4 for an unknown label."""
    known = reduce(lambda c, x: F.when(label == x[1], x[0]).otherwise(c), enumerate(LABELS), F.lit(4))
    return F.when(label != "N/A", known)


def worst(*labels: Column) -> Column:
    """Of the labels that aren't N/A the worst; N/A if none is left."""
    pairs = F.filter(F.array(*[F.struct(rank(x).alias("r"), x.alias("l")) for x in labels]), lambda s: s["r"].isNotNull())
    return F.coalesce(F.array_min(pairs)["l"], F.lit("N/A"))


def worst_of(label: Column) -> Column:
    """Aggregate: the worst label that isn't N/A."""
    return F.coalesce(F.min_by(F.when(label != "N/A", label), F.when(label != "N/A", rank(label))), F.lit("N/A"))


def band(score: Column, high: float, medium: float) -> Column:
    """Label of a score between 0 and 1."""
    return F.when(score >= high, "High").when(score >= medium, "Medium").when(score > 0, "Low").otherwise("Failed")


def ocr_label(mean: Column, has_text: Column) -> Column:
    return F.when(mean.isNull(), F.when(has_text, "Low").otherwise("Failed")).otherwise(band(mean, 0.85, 0.65))


def extraction_label(pages_with_text: Column, pages: Column) -> Column:
    ratio = pages_with_text / pages
    return F.when(ratio >= 0.9, "High").when(ratio >= 0.6, "Medium").when(ratio > 0, "Low").otherwise("Failed")


def blank_cell_label(blank: Column, cells: Column) -> Column:
    ratio = F.coalesce(F.try_divide(blank, cells), F.lit(1.0))
    return F.when(ratio > 0.5, "Low").when(ratio > 0.2, "Medium").otherwise("High")


def ragged_label(ragged: Column, rows: Column) -> Column:
    ratio = F.coalesce(F.try_divide(ragged, rows), F.lit(0.0))
    return F.when(ratio > 0.2, "Low").when(ratio > 0, "Medium").otherwise("High")


def accuracy_label(accuracy: Column) -> Column:
    """Label of a table from the accuracy in percent that its reader gives; without one it is Medium."""
    return F.when(accuracy >= 85, "High").when(accuracy >= 60, "Medium").when(accuracy.isNull(), "Medium").otherwise("Low")


def workbook_label(ragged: Column, rows: Column) -> Column:
    """Label of a sheet by its share of ragged rows."""
    return F.when(ragged == 0, "High").when(ragged / F.greatest(rows, F.lit(1)) < 0.1, "Medium").otherwise("Low")


def worst_page(label: Column) -> Column:
    """Aggregate over pages: the worst label, where an unknown one ranks as a failure and N/A as the best."""
    order = F.when(label == "N/A", 4).otherwise(F.coalesce(F.nullif(rank(label), F.lit(4)), F.lit(0)))
    return F.min_by(label, order)


# Exit codes of the tool that adds a text layer, and what they say of text, OCR and the whole.
EXITS = {
    "ok": ("High", "High", "High", False, None), "pdfa_conversion_failed": ("High", "High", "Medium", False, "PDF/A conversion failed but OCR text layer was added."),
    "already_done_ocr": ("High", "N/A", "High", False, None), "some_pages_had_errors": ("Medium", "Medium", "Medium", True, "Some pages could not be OCR'd. Review the output."),
}


def exit_confidence(code: Column) -> Column:
    """struct(text_extraction, ocr_confidence, overall, manual_review_recommended, warning) of an exit code; the other dimensions are N/A."""
    def row(text: str, ocr: str, overall: str, review: bool, warning: Column) -> Column:
        return F.struct(
            F.lit(text).alias("text_extraction"), F.lit(ocr).alias("ocr_confidence"), F.lit(overall).alias("overall"), F.lit(review).alias("manual_review_recommended"), warning.cast("string").alias("warning")
        )

    out = row("Low", "Low", "Low", True, F.concat(F.lit("ocrmypdf returned exit code: "), F.coalesce(code, F.lit("none"))))
    for name, (text, ocr, overall, review, warning) in EXITS.items():
        out = F.when(code == name, row(text, ocr, overall, review, F.lit(warning))).otherwise(out)
    return out


def aggregate(results: DataFrame, *by: str) -> DataFrame:
    """Worst label of each dimension, whether any asks for review, and all warnings in order of the key ``file``, in one row; ``warning_rows`` is for groups of any size."""
    return results.groupBy(*by).agg(
        *[worst_of(F.col(d)).alias(d) for d in DIMENSIONS if d in results.columns],
        F.bool_or("manual_review_recommended").alias("manual_review_recommended"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file", "warnings"))), lambda x: x["warnings"])).alias("warnings"),
    )


def warning_rows(results: DataFrame, *by: str) -> DataFrame:
    """(by, n, file, warning): the warnings of a group, numbered in order of their files, one row for each; for groups of any size."""
    rows = results.select(*by, "file", F.posexplode("warnings").alias("pos", "warning"))
    return ordered.numbered_within(rows, by, ["file", "pos"], "n").select(*by, "n", "file", "warning")


def badge(label: Column) -> Column:
    return F.when(label == "High", "▲").when(label == "Medium", "●").when(label.isin("Low", "Failed"), "▼").otherwise("–")


def report(results: DataFrame) -> DataFrame:
    """(file, report): the report as text; the OCR line only where it applies."""
    title = {d: d.replace("_", " ").capitalize().replace("Ocr", "OCR") for d in DIMENSIONS}
    lines = [F.when((F.col(d) != "N/A") | F.lit(d != "ocr_confidence"), F.concat(F.lit(f"{title[d]}: "), F.col(d))) for d in DIMENSIONS]
    review = F.when(F.col("manual_review_recommended"), F.lit("Manual review recommended: Yes")).otherwise(F.lit("Manual review recommended: No"))
    return results.select("file", F.concat_ws("\n", F.concat(F.lit("Overall: "), worst(*[F.col(d) for d in DIMENSIONS])), *lines, review).alias("report"))

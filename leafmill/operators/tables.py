"""Cells, layers, file names and outcomes: the small relational steps of readers and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.operators.layout import first_of

# Extension by media type, and by its long form.
MEDIA = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/svg+xml": "svg", "image/webp": "webp"}


def blank_repeats(cells: DataFrame, row: list[str], col: str = "col", value: str = "value") -> DataFrame:
    """Cells of a row with the value emptied where it equals that of the cell before (cells merged sideways)."""
    before = F.lag(value).over(Window.partitionBy(*row).orderBy(col))
    return cells.withColumn(value, F.when(F.col(value).eqNullSafe(before) & before.isNotNull(), F.lit("")).otherwise(F.col(value)))


def is_blank_row(cells: Column) -> Column:
    """Whether no cell of an array has anything but spaces."""
    return ~F.exists(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")


def numbered_images(images: DataFrame, doc: str, order: list[str], content: str) -> DataFrame:
    """Adds image_no, counted over all images of a document, and keeps the first of equal contents."""
    rows = images.withColumn("image_no", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).withColumn("_h", F.md5(F.col(content)))
    return first_of(rows, [doc, "_h"], [F.col("image_no")]).drop("_h")


def title_block(attributes: DataFrame, labels: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """(doc, label, value): the first value that isn't blank of each label; ``labels`` (tag, label) is a fixed lookup table."""
    found = attributes.withColumn("value", F.trim("value")).where(F.col("value") != "").withColumn("tag", F.upper(F.trim("tag"))).join(labels, "tag")
    return first_of(found, [doc, "label"], [F.col(c) for c in order]).select(doc, "label", "value")


def text_by_layer(texts: DataFrame, layer: str = "layer") -> DataFrame:
    """(layer, texts): texts (text, x, y) of a layer from top to bottom, then left to right."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("d"), "x", "text")))
    return texts.groupBy(layer).agg(F.transform(rows, lambda r: r["text"]).alias("texts"))


def layer_counts(layers: DataFrame, entities: DataFrame) -> DataFrame:
    """Layers (layer, ...) with the number of their entities (layer, ...), 0 for none; those with most first, then by name."""
    counts = entities.groupBy(F.trim("layer").alias("layer")).agg(F.count(F.lit(1)).alias("entities"))
    out = layers.join(counts, "layer", "left").withColumn("entities", F.coalesce("entities", F.lit(0)))
    return out.orderBy(F.desc("entities"), F.lower("layer"))


def line_confidence_class(line: Column, table: Column, image: Column, text: Column, overall: Column) -> Column:
    """Class of a preview line: the label of tables, pictures or text by how it begins, the whole document's where that is N/A; null for a blank line."""
    level = lambda c: F.when(F.lower(c) == "high", "conf_high").when(F.lower(c).isin("medium", "moderate"), "conf_medium")
    s = F.trim(line)
    own = F.when(F.startswith(s, F.lit("|")), table).when(F.startswith(s, F.lit("![")) | F.startswith(s, F.lit("\U0001f5bc")), image).otherwise(text)
    own = F.when(F.coalesce(own, F.lit("")).isin("N/A", "n/a", ""), overall).otherwise(own)
    known = F.coalesce(level(own), F.when(F.lower(own).isin("low", "failed"), "conf_low"), level(overall), F.lit("conf_low"))
    return F.when(s != "", known)


def misspelled(docs: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, word, n): words of three letters or more, in lower case, that aren't in the dictionary (word); counted before they are compared."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col(text), F.lit("[a-zA-Z']{3,}"), F.lit(0))).alias("w"))
    counts = found.groupBy("doc_id", F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(dictionary.select(F.lower("word").alias("word")).distinct(), "word", "left_anti").select("doc_id", "word", "n")


def chunk_outcome(codes: DataFrame, by: str, code: str = "code", ok: int = 0, partial: int = 1) -> DataFrame:
    """(by, total, done, part, failed, overall): outcome of a document from the codes of its chunks, null or -1 for a failed one."""
    c = F.col(code)
    counts = codes.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c == ok).alias("done"), F.count_if(c == partial).alias("part"), F.count_if(c.isNull() | (c == -1)).alias("failed")
    )
    overall = F.when(F.col("failed") == F.col("total"), "Failed").when(F.col("failed") + F.col("part") > 0, "Medium").otherwise("High")
    return counts.withColumn("overall", overall)


def batch_totals(results: DataFrame, status: str = "status", by: list[str] | None = None) -> DataFrame:
    """One row, or one for each group: total, completed, skipped and failed files."""
    s = F.col(status)
    return results.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "ok").alias("completed"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s.startswith("failed")).alias("failed"))


def elapsed(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m - h * 60, s - m * 60)).otherwise(F.format_string("%d:%02d", m, s - m * 60))


def remaining(seconds: Column, fraction: Column) -> Column:
    """Time left by the share done, null before it means much."""
    left = (seconds.cast("long") / fraction * (1 - fraction)).cast("long")
    return F.when((fraction > 0.05) & (fraction < 1) & (seconds.cast("long") > 10), elapsed(left))


def media_extension(name: Column, media_type: Column) -> Column:
    """Extension of a file name without its dot, else by its media type, else png."""
    own = F.regexp_extract(name, "[^/.][^/]*\\.([^./]+)$", 1)
    known = F.coalesce(*[F.when(media_type == k, v) for k, v in MEDIA.items()], F.lit("png"))
    return F.when(own == "jpeg", "jpg").when(own != "", own).otherwise(known)


def changed_translation(line: Column, translated: Column) -> Column:
    """A translation that says something else than its line, else null."""
    return F.when((F.trim(translated) != "") & (F.lower(line) != F.lower(translated)), translated)


def usable_words(words: DataFrame) -> DataFrame:
    """Words that have text; a confidence outside 0 to 1 becomes one half, a negative one drops the word."""
    c = F.col("conf")
    return words.where((F.trim("text") != "") & (F.isnan(c) | (c >= 0))).withColumn("conf", F.when(c.between(0, 1) & ~F.isnan(c), c).otherwise(F.lit(0.5)))

"""Pictures and files of documents: paths, links to them, and joins by path, stem, page or position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.rows import packed, unpacked
from leafmill.functions.text import base_name, safe_stem
from leafmill.operators.layout import first_of
from leafmill.operators.tables import media_extension, numbered_images
from leafmill.operators.validation import IMAGE
from leafmill.sinks.shared import durable

# What stands where a picture was, and what a picture that can't be read leaves.
PLACEHOLDER, LOST = "<!--\\s*image\\s*-->", "*[image — could not be extracted]*"


def normal_path(path: Column) -> Column:
    """A path with / between its parts, without empty parts, . and, as far as they can be taken back, .."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    up = lambda s: (F.size(s) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), s), -1) != "..")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda s, p: F.when((p == "..") & up(s), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(""), F.array_join(kept, "/"))


def inside(folder: Column, target: Column) -> Column:
    """Path of a link's target under ``folder``; null for one that leads out of it, is on the web, or holds its data itself."""
    path = normal_path(F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, F.lit("/"), target)))
    within = F.startswith(path, F.concat(normal_path(folder), F.lit("/")))
    return F.when(within & ~F.lower(target).rlike("^(https?|ftp|data):"), path)


def resolve_images(refs: DataFrame, images: DataFrame) -> DataFrame:
    """Adds ``path`` to refs (doc_id, src): that of the image (doc_id, name, path) of that name, of that base name, or without leading ./ and ../.

    The first that is there counts; null if none is.  A name that a document has
    twice stands for its smallest path.
    """
    # Written, so that the three joins can split a document of very many links.
    table = durable(images.groupBy("doc_id", "name").agg(F.min("path").alias("path")), "names")
    keys = {"_a": F.col("src"), "_b": base_name(F.col("src")), "_c": F.regexp_replace("src", "^(?:\\.\\.?/)+", "")}
    out = packed(refs, doc_id="doc_id", src="src").withColumns(keys)
    for k in keys:
        out = out.join(table.select("doc_id", F.col("name").alias(k), F.col("path").alias(k + "p")), ["doc_id", k], "left")
    found = F.coalesce(*[F.when(F.col("src") != "", F.col(k + "p")) for k in keys])
    return unpacked(out, refs.columns, path=found)


def missing_images(docs: DataFrame, files: DataFrame, folder: str = "folder", text: str = "text") -> DataFrame:
    """(doc_id, src) of images in Markdown whose file (``path``) isn't there; images on the web or in the text don't count."""
    c = F.coalesce(F.col(text), F.lit(""))
    refs = docs.select("doc_id", F.col(folder).alias("_f"), F.explode(F.regexp_extract_all(c, F.lit(IMAGE), F.lit(2))).alias("src"))
    refs = refs.where(~F.lower("src").rlike("^(https?|data):")).withColumn("path", normal_path(F.concat("_f", F.lit("/"), "src")))
    return refs.join(files.select("path").distinct(), "path", "left_anti").select("doc_id", "src")


def by_stem(outputs: DataFrame, results: DataFrame, order: str = "ord") -> DataFrame:
    """Outputs (path, ...) with the columns of the first result (source_file, ...) whose file has the same stem, null if none has."""
    found = packed(results, stem=safe_stem(F.col("source_file")), place=order)
    first = first_of(found, ["stem"], [F.col("place")]).select("stem", F.col("row").alias("first"))
    rows = packed(outputs, stem=safe_stem(F.col("path"))).join(first, "stem", "left")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in outputs.columns], *[F.col("first").getField(c).alias(c) for c in results.columns if c != order])


def attach_images(segments: DataFrame, refs: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """Segments (doc_id, seg_no from 0, text) with the lines ``ref`` of refs (doc_id, page, ord, ref) below the segment of their page.

    With ``pages`` segments are those pages in order, and images of others are
    left out; else a page beyond the last segment counts as the last.
    """
    last = segments.groupBy("doc_id").agg(F.max("seg_no").alias("_last"))
    refs = refs.select("doc_id", "page", "ord", "ref")
    if pages is None:
        at = F.least(F.col("page") - 1, F.col("_last"))
        placed = refs.join(last, "doc_id").withColumn("seg_no", at)
    else:
        numbers = F.array(*[F.lit(p) for p in sorted(pages)])
        placed = refs.join(last, "doc_id").where(F.array_contains(numbers, F.col("page"))).withColumn("seg_no", F.least(F.array_position(numbers, F.col("page")).cast("int") - 1, F.col("_last")))
    lines = placed.groupBy("doc_id", "seg_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "ref"))), lambda r: r["ref"]), "\n").alias("refs"))
    rows = packed(segments, doc_id="doc_id", seg_no="seg_no", text="text").join(lines, ["doc_id", "seg_no"], "left")
    return unpacked(rows, segments.columns, text=F.concat_ws("\n", "text", "refs"))


def zip_by_position(left: DataFrame, right: DataFrame, by: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of ``left`` with the columns of the row of ``right`` at the same place of the same document, null beyond its end."""
    place = F.row_number().over(Window.partitionBy("of").orderBy("at"))
    a, b = (packed(side, of=by, at=order).withColumn("n", place) for side, order in ((left, left_order), (right, right_order)))
    rows = a.join(b.select("of", "n", F.col("row").alias("other")), ["of", "n"], "left")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in left.columns], *[F.col("other").getField(c).alias(c) for c in right.columns if c not in (by, right_order)])


def image_link(number: Column, page: Column, content: Column) -> Column:
    """An image with its data in the link; a note where there is no data."""
    link = F.format_string("![Image %d — page %d](data:image/png;base64,%s)", number, page, F.base64(content))
    return F.coalesce(F.when(F.octet_length(content) > 0, link), F.lit(LOST))


def embed_images(docs: DataFrame, pictures: DataFrame, text: str = "text") -> DataFrame:
    """Docs with their placeholders replaced in order by pictures (doc_id, ord, page, content).

    Pictures beyond the last placeholder are left out, and placeholders beyond
    the last picture stay.  The pictures of one document come together in one row.
    """
    entry = F.struct("ord", "page", "content")
    held = pictures.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("_pics"))
    links = F.transform(F.coalesce("_pics", F.array()), lambda p, i: image_link(i + 1, p["page"], p["content"]))
    marks = F.regexp_extract_all(F.col(text), F.lit(f"(?i)({PLACEHOLDER})"), F.lit(1))
    filled = F.transform(marks, lambda m, i: F.coalesce(F.get(links, i), m))
    parts = F.split(F.col(text), f"(?i){PLACEHOLDER}", -1)
    spliced = F.array_join(F.zip_with(parts, filled, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return docs.join(held, "doc_id", "left").withColumn(text, F.when(F.size("_pics") > 0, spliced).otherwise(F.col(text))).select(*docs.columns)


def named_images(images: DataFrame, doc: str = "path") -> DataFrame:
    """Images (path, image_no, name, media_type, content) with file, link and the first of equal ones per document: image_001.png and so on."""
    kept = numbered_images(images.drop("image_no"), doc, ["name"], "content")
    file = F.concat(F.format_string("image_%03d.", "image_no"), F.lower(media_extension(base_name(F.col("name")), F.col("media_type"))))
    return kept.withColumn("file", file).withColumn("link", F.concat(F.lit("![Image "), "image_no", F.lit("](assets/"), "file", F.lit(")")))


def spine_order(spine: DataFrame, items: DataFrame) -> DataFrame:
    """Items (doc_id, item_id, ord, ...) that a book's spine (doc_id, pos, item_id) names, with their place ``pos`` in it.

    A book whose spine names none of its items has all of them, in their own order.
    """
    named = items.join(spine.select("doc_id", "item_id", "pos"), ["doc_id", "item_id"])
    rest = items.join(named.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("pos", F.col("ord"))
    return named.unionByName(rest)

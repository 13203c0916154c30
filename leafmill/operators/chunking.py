"""Chunks of words for retrieval: fixed stride, and section-aware with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import let, strip, words

SIZE, OVERLAP = 512, 50


def stride_chunks(pages: DataFrame, keys: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(keys, k, chunk): windows of ``size`` words every ``size - overlap``; a text of ``size`` words or fewer as it is."""

    def parts(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= size, F.array(F.col(text))).otherwise(many)

    return pages.select(*keys, F.posexplode(let(words(F.col(text)), parts)).alias("k", "chunk"))


def section_parts(body: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of one section: whole if short; else paragraphs packed up to ``size`` words, the last
    ``overlap`` words carried on, and a longer paragraph in pieces of ``size`` after what is carried."""

    def tail(x: Column) -> Column:
        return F.slice(x, F.greatest(F.size(x) - overlap + 1, F.lit(1)), overlap)

    none = F.array().cast("array<string>")
    text = lambda x: F.array_join(x, " ")

    def step(s: Column, p: Column) -> Column:
        full = (F.size(s["now"]) > 0) & (F.size(s["now"]) + F.size(p) > size)
        done = F.when(full, F.concat(s["done"], F.array(text(s["now"])))).otherwise(s["done"])
        now = F.when(full, tail(s["now"])).otherwise(s["now"])
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(p, i + 1, size))
        cut = F.aggregate(
            pieces,
            F.struct(done.alias("done"), now.alias("now")),
            lambda a, x: F.struct(F.concat(a["done"], F.array(text(F.concat(a["now"], x)))).alias("done"), tail(F.concat(a["now"], x)).alias("now")),
        )
        return F.struct(
            F.when(F.size(p) > size, cut["done"]).otherwise(done).alias("done"),
            F.when(F.size(p) > size, cut["now"]).otherwise(F.concat(now, p)).alias("now"),
        )

    n_words = lambda x: F.regexp_count(x, F.lit("(?U)\\S+"))
    paragraphs = F.filter(F.transform(F.split(body, "\n\n+"), words), lambda p: F.size(p) > 0)
    folded = F.aggregate(
        paragraphs,
        F.struct(none.alias("done"), none.alias("now")),
        step,
        lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(text(s["now"])))).otherwise(s["done"]),
    )
    return F.when(n_words(body) <= size, F.array(body)).otherwise(folded)


def section_chunks(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP, *, doc: str = "doc_id", order: str = "sec_no", body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """(doc, order, ``keep``, k, chunk) of sections that aren't blank; null bodies are blank."""
    parts = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(section_parts(t, size, overlap))
    return sections.select(doc, order, *(keep or []), F.posexplode(let(strip(F.col(body)), parts)).alias("k", "chunk"))


def numbered(chunks: DataFrame, doc: str, order: list[str], stem: Column) -> DataFrame:
    """Adds chunk_index, total_chunks and id within each document."""
    window = Window.partitionBy(doc)
    out = chunks.withColumn("chunk_index", F.row_number().over(window.orderBy(*order)) - 1).withColumn("total_chunks", F.count(F.lit(1)).over(window))
    return out.withColumn("id", F.format_string("%s_chunk_%04d", stem, F.col("chunk_index")))


def page_plan(docs: DataFrame, doc: str, pages: str, size: int = 30) -> DataFrame:
    """(doc, chunk_no, first, last): ranges of pages to work on in parallel; up to ``size`` pages stay whole."""
    starts = F.sequence(F.lit(0), F.greatest(F.col(pages) - 1, F.lit(0)), F.lit(size))
    return docs.select(doc, F.posexplode(starts).alias("chunk_no", "first"), F.col(pages).alias("_n")).select(
        doc, "chunk_no", "first", F.least(F.col("first") + size, F.col("_n")).alias("last")
    )


# Pages of a chunk by the least memory in GB, and up to how many pages a document stays whole.
PAGES_BY_MEMORY, WHOLE = ((16.0, 30), (8.0, 25), (0.0, 20)), 30


def pages_for(memory_gb: Column) -> Column:
    """Pages of a chunk for workers of so much memory; the least for unknown (null) or negative memory."""
    size = F.lit(PAGES_BY_MEMORY[-1][1])
    for least, pages in reversed(PAGES_BY_MEMORY[:-1]):
        size = F.when(memory_gb >= least, pages).otherwise(size)
    return size


def page_plan_for(docs: DataFrame, doc: str, pages: str, memory_gb: Column) -> DataFrame:
    """(doc, chunk_no, first, last): ranges of pages by the memory there is for each document; up to ``WHOLE`` pages stay whole.

    A document without pages has one empty range, one of an unknown number (null) none.
    """
    n = F.greatest(F.col(f"`{pages}`"), F.lit(0))
    rows = docs.where(F.col(f"`{pages}`").isNotNull()).select(F.col(f"`{doc}`").alias("of"), n.alias("n"), F.when(n <= WHOLE, F.greatest(n, F.lit(1))).otherwise(pages_for(memory_gb)).alias("size"))
    cut = rows.select("of", "n", "size", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.col("size"))).alias("chunk_no", "first"))
    return cut.select(F.col("of").alias(doc), "chunk_no", "first", F.least(F.col("first") + F.col("size"), F.col("n")).alias("last"))


def sidecar_text(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_no", text: str = "text") -> DataFrame:
    """(doc, text): texts of the chunks of a document in order, parted by form feeds; null counts as empty."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))
    return chunks.groupBy(doc).agg(F.array_join(F.transform(parts, lambda c: c["t"]), "\f").alias("text"))

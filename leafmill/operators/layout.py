"""Layout of pages: boxes, columns, lines, captions, headings by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.rows import packed, unpacked
from leafmill.functions.text import escape_html
from leafmill.sinks.shared import durable

KEYS = ["doc_id", "page_no"]


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes (structs l, t, r, b)."""
    w = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.r"), F.col(f"{b}.r")) - F.greatest(F.col(f"{a}.l"), F.col(f"{b}.l")))
    h = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.b"), F.col(f"{b}.b")) - F.greatest(F.col(f"{a}.t"), F.col(f"{b}.t")))
    area = lambda x: (F.col(f"{x}.r") - F.col(f"{x}.l")) * (F.col(f"{x}.b") - F.col(f"{x}.t"))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def bbox(polygon: Column) -> Column:
    """Rectangle around a polygon of [x, y] points."""
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(x).alias("l"), F.array_min(y).alias("t"), F.array_max(x).alias("r"), F.array_max(y).alias("b"))


def merge_words(a: DataFrame, b: DataFrame, least: float = 0.3, cell: float = 256.0) -> DataFrame:
    """Words of two readers as one set: greedy pairs of overlapping boxes keep the surer word, the rest stay.

    ``a`` and ``b`` are (doc_id, page_no, word_id, text, conf, l, t, r, b).
    Candidates meet in the cells of a grid that both boxes touch, so a page's
    words are not all paired; the greedy choice is a fold for each page over the
    candidates alone, by the words of ``a`` in order, the largest overlap first.
    """

    def cells(d: DataFrame, name: str) -> DataFrame:
        at = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        return d.select(*KEYS, F.struct(*[c for c in d.columns if c not in KEYS]).alias(name), at("l", "r").alias("cx")).select(
            *KEYS, name, "cx", F.explode(F.sequence(F.floor(F.col(f"{name}.t") / cell), F.floor(F.col(f"{name}.b") / cell))).alias("cy")
        )

    near = cells(a, "x").join(cells(b, "y"), [*KEYS, "cx", "cy"]).withColumn("iou", iou("x", "y")).where(F.col("iou") >= least)
    pairs = near.select(*KEYS, F.col("x.word_id").alias("i"), F.col("y.word_id").alias("j"), "iou", F.col("x.conf").alias("ci"), F.col("y.conf").alias("cj")).distinct()

    best = F.struct("i", (-F.col("iou")).alias("d"), "j", (F.col("cj") > F.col("ci")).alias("second"))
    page = pairs.groupBy(*KEYS).agg(F.array_sort(F.collect_list(best)).alias("cs"))
    none = F.filter("cs", lambda c: F.lit(False))
    free = lambda s, c: ~F.exists(s, lambda o: (o["i"] == c["i"]) | (o["j"] == c["j"]))
    greedy = F.aggregate("cs", none, lambda s, c: F.when(free(s, c), F.concat(s, F.array(c))).otherwise(s))
    taken = page.select(*KEYS, F.explode(greedy).alias("p")).select(*KEYS, "p.*")
    lose_a = taken.where("second").select(*KEYS, F.col("i").alias("word_id"))
    lose_b = taken.where("NOT second").select(*KEYS, F.col("j").alias("word_id"))
    return a.join(lose_a, [*KEYS, "word_id"], "left_anti").unionByName(b.join(lose_b, [*KEYS, "word_id"], "left_anti"))


def lines_of_words(words: DataFrame, factor: float = 0.5) -> DataFrame:
    """Adds line_no: words in order of their centres; a line ends where a centre is too far from that of its first word."""
    mid = (F.col("t") + F.col("b")) / 2
    entry = F.struct(mid.alias("cy"), ((F.col("l") + F.col("r")) / 2).alias("cx"), (F.col("b") - F.col("t")).alias("h"), *[F.col(c) for c in words.columns if c not in KEYS])
    page = words.groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).alias("ws"))

    def step(s: Column, w: Column) -> Column:
        new = s["cy"].isNull() | (F.abs(w["cy"] - s["cy"]) > factor * F.when(s["h"] > 0, s["h"]).otherwise(10.0))
        return F.struct(
            F.concat(s["nos"], F.array(s["no"] + new.cast("int"))).alias("nos"),
            (s["no"] + new.cast("int")).alias("no"),
            F.when(new, w["cy"]).otherwise(s["cy"]).alias("cy"),
            F.when(new, w["h"]).otherwise(s["h"]).alias("h"),
        )

    zero = F.struct(F.array().cast("array<int>").alias("nos"), F.lit(0).alias("no"), F.lit(None).cast("double").alias("cy"), F.lit(None).cast("double").alias("h"))
    nos = F.aggregate("ws", zero, step, lambda s: s["nos"])
    return page.select(*KEYS, F.explode(F.arrays_zip("ws", nos.alias("no"))).alias("z")).select(*KEYS, F.col("z.no").alias("line_no"), *[F.col(f"z.ws.{c}").alias(c) for c in words.columns if c not in KEYS])


def line_confidence(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text, conf): words of each line in order, and their mean confidence."""
    ordered = F.array_sort(F.collect_list(F.struct("l", "text")))
    return lines.groupBy(*KEYS, "line_no").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.avg("conf").alias("conf"))


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (kind, text) that are text (kind 0) and aren't blank."""
    return blocks.where((F.col("kind") == 0) & (F.trim("text") != ""))


def numbered_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_num, text, conf): words by the line number that their reader gives, in order, with their mean confidence.

    Numbers of different blocks that are equal are one line.
    """
    ordered = F.array_sort(F.collect_list(F.struct("word_id", "text")))
    return words.groupBy(*KEYS, "line_num").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.avg("conf").alias("conf"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): text of blocks with col_no, column by column from left to right and each from top to bottom."""
    ordered = F.array_sort(F.collect_list(F.struct("col_no", "y0", "block_no", "text")))
    return blocks.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def mark_headings(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """Pages with the lines that ``heading_levels`` found marked as headings; of equal texts the last level counts."""
    last = headings.groupBy(*KEYS, "text").agg(F.max_by("level", "line_id").alias("level"))
    held = durable(last.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("text", "level"))).alias("levels")), "levels")

    def marked(line: Column) -> Column:
        level = F.try_element_at("levels", F.trim(line))
        return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim(line))).otherwise(line)

    text = F.array_join(F.transform(F.split("text", "\n", -1), marked), "\n")
    rows = packed(pages, doc_id="doc_id", page_no="page_no", text="text").join(held, KEYS, "left")
    return unpacked(rows, pages.columns, text=F.when(F.col("levels").isNotNull(), text).otherwise(F.col("text")))


def captions(images: DataFrame, blocks: DataFrame, gap: float = 46.0, overlap: float = 0.25, limit: int = 200) -> DataFrame:
    """(doc_id, page_no, image_id, caption): the nearest caption block above or below each image.

    ``images`` (doc_id, page_no, image_id, x0, y0, x1, y1), ``blocks`` (doc_id,
    page_no, block_no, x0, y0, x1, y1, text).
    """
    noun = "(?i)^(figure|fig\\.?|table|chart|graph|diagram|image|photo|plate|exhibit|illustration|map|scheme|drawing|picture)\\s*[\\d.:\\-—–]+"
    i, b = images.alias("i"), blocks.where(F.trim("text").rlike(noun)).alias("b")
    wide = F.least(F.col("i.x1"), F.col("b.x1")) - F.greatest(F.col("i.x0"), F.col("b.x0"))
    below, above = F.col("b.y0") - F.col("i.y1"), F.col("i.y0") - F.col("b.y1")
    dist = F.least(F.when(below >= 0, below), F.when(above >= 0, above))
    same = [F.col(f"i.{k}") == F.col(f"b.{k}") for k in KEYS]
    pairs = i.join(b, [*same][0] & [*same][1] & (wide >= overlap * (F.col("i.x1") - F.col("i.x0"))) & (dist < gap))
    order = Window.partitionBy("i.doc_id", "i.page_no", "i.image_id").orderBy(dist, F.col("b.block_no"))
    first = F.trim(F.substring_index(F.col("b.text"), "\n", 1))
    text = F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit), F.lit("…"))).otherwise(first)
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("i.doc_id", "i.page_no", "i.image_id", text.alias("caption"))


def columns_of_blocks(blocks: DataFrame, gap: float = 0.05) -> DataFrame:
    """Adds col_no: columns part at the two widest gaps between block centres over 5 % of the page's width; each needs two blocks."""
    page = Window.partitionBy(*KEYS)
    d = packed(blocks, doc_id="doc_id", page_no="page_no", block_no="block_no", x0="x0", x1="x1").withColumn("_cx", (F.col("x0") + F.col("x1")) / 2).withColumn("_w", F.max("x1").over(page) - F.min("x0").over(page))
    d = d.withColumn("_gap", F.lead("_cx").over(page.orderBy("_cx", "block_no")) - F.col("_cx"))
    cut = d.where(F.col("_gap") > gap * F.col("_w")).withColumn("_n", F.row_number().over(page.orderBy(F.desc("_gap"), "_cx"))).where("_n <= 2")
    cuts = cut.groupBy(*KEYS).agg(F.collect_list(F.col("_cx") + F.col("_gap") / 2).alias("_cuts"))
    d = d.join(cuts, KEYS, "left").withColumn("_c", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda x: x < F.col("_cx"))))
    d = d.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "_c"))).withColumn("_least", F.min("_k").over(page))
    return unpacked(d, blocks.columns, col_no=F.when(F.col("_least") >= 2, F.col("_c")).otherwise(F.lit(0)))


def heading_levels(spans: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_id, text, level): lines larger than the page's median size, or bold, as headings 2 to 4.

    ``spans``: doc_id, page_no, line_id, span_no, text, size, flags (16: bold).
    """
    base = spans.groupBy(*KEYS).agg(F.median("size").alias("base"))
    n = F.length("text")
    line = spans.groupBy(*KEYS, "line_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "").alias("text"),
        (F.sum(F.col("size") * n) / F.greatest(F.sum(n), F.lit(1))).alias("size"),
        F.bool_and(F.col("flags").bitwiseAND(16) != 0).alias("bold"),
    )
    r = F.col("size") / F.col("base")
    level = F.when(r >= 2.0, 2).when(r >= 1.5, 3).when((r >= 1.3) | (F.col("bold") & (r >= 1.15)), 4)
    return line.join(base, KEYS).where((F.length(F.trim("text")) > 0) & (F.length("text") < 120)).withColumn("level", level).where("level IS NOT NULL").select(*KEYS, "line_id", F.trim("text").alias("text"), "level")


def scanned(pages: DataFrame, least: float = 20.0) -> DataFrame:
    """(doc_id, scanned): whether the first three pages have under ``least`` signs on average."""
    return pages.where("page_no <= 3").groupBy("doc_id").agg((F.avg(F.length(F.trim("text"))) < least).alias("scanned"))


def rectangles_at(points: DataFrame, rects: DataFrame, row: str = "row", col: str = "col", sheet: str = "sheet") -> DataFrame:
    """(every column of ``points``, rect): each point with the rectangle of its sheet that it is in, null if none.

    ``rects`` has sheet, min_row, min_col, max_row, max_col and other columns;
    rect is the whole row.  Rectangles of a sheet don't overlap; if some do, a
    point comes once for each.  Each rectangle lies on a grid of tiles at least as
    high and wide as itself, so it is in four tiles at most whatever its size,
    and a point probes its own tile of each grid there is; of disjoint rectangles
    nine at most meet a tile.  Nulls and empty rectangles meet nothing.
    """
    level = lambda n: F.ceil(F.log2(F.col(n).cast("double"))).cast("int")
    r = rects.select(F.struct(*[F.col(f"`{c}`") for c in rects.columns]).alias("rect")).where("rect.min_row <= rect.max_row AND rect.min_col <= rect.max_col")
    r = r.withColumn("h", F.col("rect.max_row").cast("long") - F.col("rect.min_row") + 1).withColumn("w", F.col("rect.max_col").cast("long") - F.col("rect.min_col") + 1)
    r = r.withColumn("lh", level("h")).withColumn("lw", level("w"))
    # As many grids as there are pairs of powers of two, whatever the number of rectangles.
    grids = sorted((g["lh"], g["lw"]) for g in r.select("lh", "lw").distinct().collect())
    tile = lambda c, n: F.floor(c.cast("long") / F.pow(F.lit(2.0), n)).cast("long")
    tiled = r.withColumn("tr", F.explode(F.sequence(tile(F.col("rect.min_row"), F.col("lh")), tile(F.col("rect.max_row"), F.col("lh")))))
    tiled = tiled.withColumn("tc", F.explode(F.sequence(tile(F.col("rect.min_col"), F.col("lw")), tile(F.col("rect.max_col"), F.col("lw"))))).select(F.col("rect.sheet").alias("s"), "lh", "lw", "tr", "tc", "rect")
    p = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("p"), F.monotonically_increasing_id().alias("own"))
    at = lambda n: F.col("p").getField(n)
    if not grids:
        return points.withColumn("rect", F.lit(None).cast(tiled.schema["rect"].dataType))
    where = F.explode(F.array(*[F.struct(F.lit(h).alias("lh"), F.lit(w).alias("lw"), tile(at(row), F.lit(h)).alias("tr"), tile(at(col), F.lit(w)).alias("tc")) for h, w in grids]))
    probes = durable(p, "points")
    hit = (
        probes.select(at(sheet).alias("s"), at(row).alias("pr"), at(col).alias("pc"), "own", where.alias("g")).select("s", "pr", "pc", "own", "g.*").join(tiled, ["s", "lh", "lw", "tr", "tc"])
        .where("pr BETWEEN rect.min_row AND rect.max_row AND pc BETWEEN rect.min_col AND rect.max_col").select("own", "rect")
    )
    return probes.join(hit, "own", "left").select("p.*", "rect")


def fill_merged(cells: DataFrame, merges: DataFrame, missing: bool = True) -> DataFrame:
    """Cells with the value of the top left cell of the merged range that they are in.

    With ``missing``, cells of a range that the table has no row for come too:
    ranges are exploded to their cells, no more than a sheet has.  Without,
    ranges of any size are looked up by tiles and no row is added.
    """
    if not missing:
        top = cells.select(F.col("sheet").alias("s"), F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("top"))
        found = rectangles_at(cells.select("sheet", "row", "col", "value"), merges)
        return found.join(top, (F.col("sheet") == F.col("s")) & (F.col("rect.min_row") == F.col("r")) & (F.col("rect.min_col") == F.col("c")), "left").select("sheet", "row", "col", F.coalesce("top", "value").alias("value"))
    m = merges.select("sheet", "min_row", "min_col", F.explode(F.sequence("min_row", "max_row")).alias("row"), "max_col").select("sheet", "min_row", "min_col", "row", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    top = cells.select("sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("value").alias("top"))
    return cells.join(m.join(top, ["sheet", "min_row", "min_col"]), ["sheet", "row", "col"], "full").select("sheet", "row", "col", F.coalesce("top", "value").alias("value"))


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key in an order (images by reference or by hash, contents by level and title)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def hocr(words: DataFrame, width: int, height: int) -> DataFrame:
    """(doc_id, page_no, hocr): words as hOCR spans, boxes within the page, empty boxes left out."""
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), F.col(c).cast("int")))
    w = words.select(*KEYS, "word_id", "text", "conf", clamp("l", width).alias("l"), clamp("t", height).alias("t"), clamp("r", width).alias("r"), clamp("b", height).alias("b")).where("r > l AND b > t")
    span = F.format_string("<span class='ocrx_word' title='bbox %d %d %d %d; x_wconf %d'>%s</span>", "l", "t", "r", "b", (F.col("conf") * 100).cast("int"), escape_html(F.col("text")))
    return w.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", span.alias("s")))), lambda x: x["s"]), "\n").alias("hocr"))



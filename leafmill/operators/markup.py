"""Structure of lines: classes of Markdown lines and their runs, contents, pages by rules, sections of plain text, runs of type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import explode_lines, line_states, strip

# Heading lines, captions of images, rules, and the private-use block that holds shifted ASCII.
HEADING_LINE = "^(#{1,6})\\s+(.+)$"
IMAGE_LINE = "^!\\[[^\\]]*\\]\\([^)]+\\)"
RULE_LINE = "^-{3,}\\s*$"
PRIVATE_BASE = 0xF700
SOFT_HYPHEN, BREAKS = "\u00ad", "\ue048\ue061"


def toc_entries(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, level, title) of all heading lines, those in fences too."""
    lines = explode_lines(docs.select(key, F.col(text).alias("text")), [key], newline_only=True)
    return lines.where(F.col("line").rlike(HEADING_LINE)).select(
        key, F.col("pos").alias("ord"), F.length(F.regexp_extract("line", HEADING_LINE, 1)).alias("level"), strip(F.regexp_extract("line", HEADING_LINE, 2)).alias("title")
    )


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line, kind): what a preview shows each line as, ``text`` where nothing else fits.

    Front matter opens with a rule before any other content and closes with the
    next one; fences in it don't count.  A null text has no lines.  No shuffle.
    """
    lines = docs.select(key, F.posexplode(line_states(F.col(text))).alias("pos", "l")).select(key, "pos", "l.line", "l.state").withColumn("t", strip(F.col("line")))
    t, line = F.col("t"), F.col("line")
    kind = (
        F.when(F.col("state") == "m", "frontmatter")
        .when(F.col("state") == "c", "code_block")
        .when(t.rlike("^(-{3,}|\\*{3,}|_{3,})$"), "hr")
        .when(line.startswith("# "), "heading")
        .when(line.startswith("## "), "heading2")
        .when(line.rlike("^#{3,6} "), "heading3")
        .when(t.startswith("|"), "table")
        .when(t.startswith("*Page ") | line.contains('<a id="page-'), "page_marker")
        .when(t.startswith("> ") | (t == ">"), "blockquote")
        .when(t.rlike(IMAGE_LINE), "image_ref")
        .otherwise("text")
    )
    return lines.select(key, "pos", "line", kind.alias("kind"))


def runs(lines: DataFrame, key: str = "doc_id", tag: str = "kind") -> DataFrame:
    """(key, run_no, tag, first, last): maximal runs of lines of one tag, as an island query."""
    order = Window.partitionBy(key).orderBy("pos")
    new = ~F.col(tag).eqNullSafe(F.lag(tag).over(order)) | (F.row_number().over(order) == 1)
    marked = lines.withColumn("run_no", F.sum(new.cast("int")).over(order))
    return marked.groupBy(key, "run_no", tag).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def pages_by_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_no, text): each line that is a rule opens the next page; the rules themselves go."""
    lines = explode_lines(docs.select(key, F.col(text).alias("text")), [key])
    rule = F.col("line").rlike(RULE_LINE)
    lines = lines.withColumn("page_no", 1 + F.sum(rule.cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    body = F.array_sort(F.collect_list(F.when(~rule, F.struct("pos", "line"))))
    return lines.groupBy(key, "page_no").agg(F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("text"))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first and small letters after it."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("\\p{L}+|\\P{L}+"), F.lit(0)), F.initcap), "")


def plain_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sec_no, heading, body) of text without marks.

    A heading is a short line of capitals, or a numbered one with a capital,
    before a blank line or the end; its level is that of its number.  Section 0
    is what comes before the first heading, and is left out if blank.
    """
    lines = explode_lines(docs.select(key, F.col(text).alias("text")), [key], newline_only=True).withColumn("t", strip(F.col("line")))
    order = Window.partitionBy(key).orderBy("pos")
    t, size = F.col("t"), F.length("t")
    capitals = (F.upper(t) == t) & (F.lower(t) != t)
    numbered = t.rlike("^\\d+(\\.\\d+)*\\.?\\s+[A-Z]")
    short = (capitals & size.between(3, 79) & ~t.rlike("^[|\\-=*]")) | (numbered & (size < 80))
    lines = lines.withColumn("head", short & (F.coalesce(F.lead("t").over(order), F.lit("")) == ""))
    number = F.regexp_extract(t, "^(\\d+(?:\\.\\d+)*)", 1)
    level = F.when(number == "", 2).otherwise(F.least(F.size(F.split(number, "\\.")) + 1, F.lit(6)))
    title = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.when(capitals, title_case(t)).otherwise(t))
    lines = lines.withColumn("sec_no", F.sum(F.col("head").cast("int")).over(order)).withColumn("title", F.when(F.col("head"), title))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "t")))), lambda x: x["t"]), "\n")
    found = lines.groupBy(key, "sec_no").agg(F.coalesce(F.max("title"), F.lit("")).alias("heading"), strip(body).alias("body"))
    return found.where((F.col("heading") != "") | (F.col("body") != ""))


def type_runs(rows: DataFrame, keys: list[str], order: str = "run_no") -> DataFrame:
    """(keys, text): runs (text, bold, italic) of a paragraph in Markdown, in order; empty runs go."""
    mark = F.concat(F.when(F.col("bold"), F.lit("**")).otherwise(F.lit("")), F.when(F.col("italic"), F.lit("*")).otherwise(F.lit("")))
    part = F.struct(order, F.concat(mark, F.col("text"), mark).alias("x"))
    full = rows.where(F.length("text") > 0)
    return full.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["x"]), "").alias("text"))


def bullet(text: Column, level: Column) -> Column:
    """A list item, indented by two spaces for each level over 0."""
    return F.concat(F.repeat(F.lit("  "), level), F.lit("- "), text)


def quote(text: Column) -> Column:
    """A block quote of speaker notes."""
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


def element_level(label: Column) -> Column:
    """Heading level of a layout label: a number from 1 to 6 in it, else by its kind."""
    digit = F.regexp_extract(label, "(\\d+)", 1)
    n = F.when(F.length(digit).between(1, 9), digit.cast("int"))
    kind = F.when(label.contains("subtitle"), 2).when(label.contains("title"), 1).when(label.contains("heading") | label.contains("section_header"), 2).otherwise(3)
    return F.when(n.between(1, 6), n).otherwise(kind)


def clean_glyphs(text: Column) -> Column:
    """Shifted private-use glyphs as the ASCII they stand for (others of the block and soft hyphens go), break glyphs as rules, image comments as a note."""
    block = [chr(PRIVATE_BASE + i) for i in range(256)]
    shown = [chr(i) for i in range(32, 127)]
    source = block[32:127] + block[:32] + block[127:] + [SOFT_HYPHEN]
    out = F.translate(text, "".join(source), "".join(shown))
    out = F.regexp_replace(out, f"[{BREAKS}]", "\n\n---\n\n")
    return F.regexp_replace(out, "(?i)<!--\\s*image\\s*-->", "*[image]*")


# Marks within a line.
INLINE = {"list_bullet": "^(\\s*)([-*]|\\d+\\.)\\s", "inline_code": "`([^`]+)`", "bold": "\\*\\*([^*]+)\\*\\*", "link": "\\[([^\\]]+)\\]\\([^)]+\\)"}


def spans(line: Column, kind: str) -> Column:
    """array of struct(start, end): where marks of a kind stand in a line, in signs from 0."""
    pattern = INLINE[kind]
    before = F.transform(F.split(line, pattern, -1), F.length)
    inside = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.length)
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + p["a"] + p["b"]
        return F.struct(F.concat(s["out"], F.array(F.struct((s["at"] + p["a"]).alias("start"), end.alias("end")))).alias("out"), end.alias("at"))

    pairs = F.zip_with(F.slice(before, F.lit(1), F.size(inside)), inside, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def page_anchors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Docs with rules made into page marks: each line of dashes begins the next page, and page 1 is marked at the start."""
    mark = lambda n: F.format_string('<a id="page-%d"></a>', n)
    parts = F.split(F.col(text), "(?m)^-{3,}\\s*$", -1)
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(mark(i + 1), F.when(i > 0, F.concat(F.lit("\n\n---\n"), F.format_string("*Page %d*", i + 1))).otherwise("\n"), p)), "")
    return docs.withColumn(text, joined)

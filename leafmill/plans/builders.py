"""Output builders over documents, one row for each: all of them are functions of one row, without a shuffle.

``assemble`` gathers sections (doc_id, sec_no, heading, body, page_number) and
whatever else there is of a document into that row; ``render`` picks a builder by
the name of a format, and ``write`` stores what it makes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.text import base_name, escape_html, extension, safe_stem, strip, strip_markdown
from leafmill.operators.chunking import numbered, section_chunks
from leafmill.operators.confidence import DIMENSIONS
from leafmill.operators.rules import Profile
from leafmill.sinks.files import write_files

#: Types of what a document may have beside its sections; what it has not is null.
PARTS = {
    "source_file": "string",
    "alias": "string",
    "engine": "string",
    "confidence": "struct<overall:string," + ",".join(f"{d}:string" for d in DIMENSIONS) + ",manual_review_recommended:boolean,notes:array<string>,warnings:array<string>>",
    "toc": "array<struct<level:int,title:string,page:int>>",
    "assets": "array<string>",
    "warnings": "array<string>",
}
STYLE = "body{max-width:50rem;margin:2rem auto;font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid;padding:.3rem}"
#: Rows of a table that is shown.
ROWS = 10_000


@dataclass(frozen=True)
class Options:
    """What goes into an output."""

    confidence: bool = True
    pages: bool = True
    toc: bool = True
    front_matter: bool = False
    flavor: str = "GFM"
    converted_at: str = ""


def assemble(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, the columns of ``PARTS``, sections): documents with their sections in order, each with ``new_page``.

    ``docs`` has doc_id and any of ``PARTS``; a document without sections has an
    empty array.  Sections of one document are gathered in one row by one shuffle.
    """
    before = Window.partitionBy("doc_id").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("page_number").isNotNull() & ~F.col("page_number").eqNullSafe(F.last("page_number", ignorenulls=True).over(before))
    entry = F.struct("sec_no", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("body", F.lit("")).alias("body"), "page_number", "new_page")
    gathered = sections.withColumn("new_page", new).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("sections"))
    parts = [F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in PARTS.items()]
    return docs.select("doc_id", *parts).join(gathered, "doc_id", "left").withColumn("sections", F.coalesce("sections", F.array()))


def _block(on: bool, *lines: Column) -> Column:
    """Lines of an output, or none."""
    return F.filter(F.array(*lines), lambda x: x.isNotNull()) if on else F.array().cast("array<string>")


def _sections(f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform("sections", lambda s: F.filter(f(s), lambda x: x.isNotNull())))


def _title(heading: Column) -> Column:
    return strip(F.regexp_replace(heading, "^#+", ""))


def _review() -> Column:
    return F.when(F.col("confidence.manual_review_recommended"), " Manual review recommended.").otherwise("")


def _summary(form: str) -> Column:
    """The confidence of a document in one line, null where it has none."""
    return F.when(F.col("confidence").isNotNull(), F.format_string(form, "confidence.overall", _review()))


def obsidian(body: Column) -> Column:
    """Links within the document or to its assets as wiki links."""
    return F.regexp_replace(body, "\\[([^\\]]+)\\]\\(((?:#|assets/)[^)]*)\\)", "[[$2|$1]]")


def _entry_line(level: Column, title: Column, page: Column, flavor: str) -> Column:
    link = F.when(page.isNotNull(), F.concat(F.lit("#page-"), page)).otherwise(F.lit("#"))
    plain = F.concat(F.lit("["), title, F.lit("]("), link, F.lit(")"))
    wiki = F.when(page.isNotNull(), F.concat(F.lit("[["), link, F.lit("|"), title, F.lit("]]"))).otherwise(plain)
    return F.concat(F.repeat(F.lit("  "), level - 1), F.lit("- "), wiki if flavor == "Obsidian" else plain)


def contents_block(toc: Column, flavor: str = "GFM") -> Column:
    """Entries (level, title, page) as a list of links; null where there are none."""
    lines = F.array_join(F.transform(toc, lambda e: _entry_line(e["level"], e["title"], e["page"], flavor)), "\n")
    return F.when(F.size(toc) > 0, F.concat(F.lit("## Table of Contents\n\n"), lines, F.lit("\n\n---")))


def contents(toc: DataFrame, flavor: str = "GFM") -> DataFrame:
    """(doc_id, toc) of entries (doc_id, ord, level, title, page)."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ord", "level", "title", "page"))), lambda e: F.struct(e["level"].alias("level"), e["title"].alias("title"), e["page"].alias("page")))
    return toc.groupBy("doc_id").agg(contents_block(entries, flavor).alias("toc"))


def safe_tag(text: Column) -> Column:
    """Text as a tag: other signs than letters, digits, _, / and - as underscores, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_/-]", "_"), "^_+|_+$", ""))


def front_matter(source: Column, converted_at: str, flavor: str = "GFM", engine: Column | None = None, overall: Column | None = None, review: Column | None = None) -> Column:
    """Title, source and how it was converted, between rules; values can't break out of their quotes."""
    safe = F.replace(F.translate(source, '"\n', "' "), F.lit(":"), F.lit(" -"))
    title = F.regexp_replace(safe, "(?<=.)\\.[^.]*$", "")
    quoted = lambda name, c: F.concat(F.lit(f'{name}: "'), c, F.lit('"'))
    ext = F.regexp_replace(extension(safe), "^[.]", "")
    lines = [F.lit("---"), quoted("title", title), quoted("source", safe), F.lit(f"converted: {converted_at}")]
    lines += [] if engine is None else [F.when(engine != "", quoted("engine", engine))]
    lines.append(F.lit(f'markdown_flavor: "{flavor}"'))
    lines += [] if overall is None else [quoted("confidence", overall)]
    lines += [] if review is None else [F.when(review, F.lit("review_recommended: true"))]
    if flavor == "Obsidian":
        lines.append(F.concat(F.lit("tags: ["), safe_tag(title), F.when(ext != "", F.concat(F.lit(", converted/"), ext)).otherwise(""), F.lit("]")))
    return F.concat_ws("\n", *lines, F.lit("---"))


def markdown(o: Options = Options()) -> Column:  # noqa: B008
    """Front matter, confidence, contents, and sections with an anchor where the page changes."""
    name = F.coalesce(base_name(F.col("source_file")), F.lit("unknown"))
    has = F.col("confidence").isNotNull()
    overall = F.when(has, F.coalesce("confidence.overall", F.lit("N/A")))
    matter = front_matter(name, o.converted_at, o.flavor, F.coalesce("engine", F.lit("")), overall, F.when(has, F.col("confidence.manual_review_recommended")))
    toc, note = contents_block(F.col("toc"), o.flavor), _summary("> Conversion confidence: %s.%s")

    def section(s: Column) -> Column:
        text = strip(s["body"])
        anchor = F.when(s["new_page"], F.format_string('<a id="page-%d"></a>\n\n---\n*Page %d*', s["page_number"], s["page_number"]))
        return F.array(
            anchor if o.pages else F.lit(None).cast("string"), F.when(s["heading"] != "", s["heading"]),
            F.when(s["body"] != "", obsidian(text) if o.flavor == "Obsidian" else text), F.lit(""),
        )

    lines = F.concat(
        _block(o.front_matter, matter, F.lit("")), _block(o.confidence, note, F.when(note.isNotNull(), "")), _block(o.toc, toc, F.when(toc.isNotNull(), "")), _sections(section)
    )
    return F.concat(strip(F.array_join(lines, "\n")), F.lit("\n"))


def json_document(o: Options = Options()) -> Column:  # noqa: B008
    """The parts of a document as JSON; keys without a value are left out, but for sections, assets and warnings."""
    head = F.struct(
        base_name(F.col("source_file")).alias("source_file"), F.lit(o.converted_at).alias("converted_at"), F.coalesce("engine", F.lit("unknown")).alias("engine"), F.lit("1.0").alias("format_version")
    )
    entry = lambda s: F.struct(
        F.when(s["heading"] != "", _title(s["heading"])).alias("heading"), F.when(s["body"] != "", strip(s["body"])).alias("body"), (s["page_number"] if o.pages else F.lit(None).cast("int")).alias("page")
    )
    sections = F.filter(F.transform("sections", entry), lambda e: e["heading"].isNotNull() | e["body"].isNotNull() | e["page"].isNotNull())
    none = F.array().cast("array<string>")
    whole = F.struct(
        head.alias("document"),
        *([F.col("confidence")] if o.confidence else []),
        *([F.when(F.size("toc") > 0, F.col("toc")).alias("table_of_contents")] if o.toc else []),
        sections.alias("sections"),
        F.transform(F.coalesce("assets", none), base_name).alias("assets"),
        F.coalesce("warnings", none).alias("warnings"),
    )
    return F.to_json(whole, {"pretty": "true", "ignoreNullFields": "true"})


def plain_text(o: Options = Options()) -> Column:  # noqa: B008
    """Upper-case title and headings, underlined, and bodies without marks."""
    title = F.regexp_replace(F.coalesce(base_name(F.col("source_file")), F.lit("")), "(?<=.)\\.[^.]*$", "")
    rule = lambda c, sign: F.repeat(F.lit(sign), F.length(c))
    note = _summary("[Conversion confidence: %s.%s]")
    entry = lambda e: F.concat(F.repeat(F.lit("  "), e["level"] - 1), e["title"], F.when(e["page"].isNotNull(), F.format_string("  (p. %d)", e["page"])).otherwise(""))
    toc = F.when(F.size("toc") > 0, F.concat(F.lit("TABLE OF CONTENTS\n-----------------\n"), F.array_join(F.transform("toc", entry), "\n"), F.lit("\n\n---\n")))

    def section(s: Column) -> Column:
        name = _title(s["heading"])
        page = F.when(s["new_page"], F.format_string("--- Page %d ---\n", s["page_number"]))
        return F.array(
            page if o.pages else F.lit(None).cast("string"),
            F.when(s["heading"] != "", F.concat(F.upper(name), F.lit("\n"), rule(name, "-"), F.lit("\n"))),
            F.when(s["body"] != "", F.concat(strip_markdown(strip(s["body"])), F.lit("\n"))),
        )

    lines = F.concat(_block(True, F.upper(title), rule(title, "="), F.lit("")), _block(o.confidence, note, F.when(note.isNotNull(), "")), _block(o.toc, toc), _sections(section))
    return F.concat(strip(F.array_join(lines, "\n")), F.lit("\n"))


def body_html(body: Column) -> Column:
    """Body as HTML: a fold over its lines for fences and tables, patterns for what is inside a line."""

    def spans(c: Column) -> Column:
        for pattern, new in (
            ("!\\[([^\\]]*)\\]\\(([^)]+)\\)", '<img src="$2" alt="$1">'),
            ("\\[([^\\]]+)\\]\\(([^)]+)\\)", '<a href="$2">$1</a>'),
            ("\\*\\*(.+?)\\*\\*", "<strong>$1</strong>"),
            ("\\*(.+?)\\*", "<em>$1</em>"),
            ("`(.+?)`", "<code>$1</code>"),
        ):
            c = F.regexp_replace(c, pattern, new)
        return c

    def step(s: Column, both: Column) -> Column:
        line, t = both["line"], both["t"]
        fence, row = F.startswith(t, F.lit("```")), F.startswith(t, F.lit("|"))
        cells = F.transform(F.split(F.regexp_replace(t, "^\\||\\|$", ""), "\\|", -1), strip)
        ruler = F.forall(cells, lambda x: x.rlike("^[-: ]*$"))
        tag = F.when(s["table"], F.lit("td")).otherwise(F.lit("th"))
        tr = F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda x: F.concat(F.lit("<"), tag, F.lit(">"), spans(escape_html(x)), F.lit("</"), tag, F.lit(">"))), ""), F.lit("</tr>"))
        level = F.length(F.regexp_extract(t, "^(#{1,6})\\s", 1)).cast("string")
        plain = (
            F.when(t == "", F.lit(""))
            .when(t.rlike("^#{1,6}\\s"), F.concat(F.lit("<h"), level, F.lit(">"), spans(escape_html(F.regexp_replace(t, "^#+\\s+", ""))), F.lit("</h"), level, F.lit(">")))
            .when(t.rlike("^-{3,}$"), F.lit("<hr>"))
            .when(t.rlike('^<a id="[^"]*"></a>$'), t)
            .otherwise(F.concat(F.lit("<p>"), spans(escape_html(t)), F.lit("</p>")))
        )
        end = F.when(s["table"] & ~row, F.lit("</table>\n")).otherwise(F.lit(""))
        new = (
            F.when(s["code"] & ~fence, escape_html(line))
            .when(fence, F.when(s["code"], F.lit("</code></pre>")).otherwise(F.concat(end, F.lit("<pre><code>"))))
            .when(row, F.when(ruler, F.lit("")).otherwise(F.concat(F.when(s["table"], F.lit("")).otherwise(F.lit("<table>\n")), tr)))
            .otherwise(F.concat(end, plain))
        )
        return F.struct(F.concat(s["out"], F.array(new)).alias("out"), (s["code"] != fence).alias("code"), (row & ~s["code"]).alias("table"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("code"), F.lit(False).alias("table"))
    lines = F.transform(F.split(body, "\n", -1), lambda x: F.struct(x.alias("line"), strip(x).alias("t")))
    return F.aggregate(lines, start, step, lambda s: F.array_join(F.filter(F.concat(s["out"], F.array(F.when(s["table"], F.lit("</table>")).otherwise(F.lit("")))), lambda x: x != ""), "\n"))


def html(o: Options = Options()) -> Column:  # noqa: B008
    """A page that stands alone: title, confidence, contents, and sections with a mark where the page changes."""
    title = escape_html(F.regexp_replace(F.coalesce(base_name(F.col("source_file")), F.lit("")), "(?<=.)\\.[^.]*$", ""))
    head = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>'),
        title, F.lit(f"</title>\n<style>{STYLE}</style>\n</head>\n<body>\n<h1>"), title, F.lit("</h1>"),
    )
    note = F.when(F.col("confidence").isNotNull(), F.concat(F.lit('<blockquote class="confidence">'), escape_html(_summary("Conversion confidence: %s.%s")), F.lit("</blockquote>")))
    item = lambda e: F.concat(
        F.repeat(F.lit("  "), e["level"]), F.lit('<li><a href="'), F.coalesce(F.concat(F.lit("#page-"), e["page"]), F.lit("#")), F.lit('">'), escape_html(e["title"]), F.lit("</a></li>")
    )
    toc = F.when(F.size("toc") > 0, F.concat(F.lit('<nav class="toc">\n<h2>Table of Contents</h2>\n<ul>\n'), F.array_join(F.transform("toc", item), "\n"), F.lit("\n</ul>\n</nav>\n<hr>")))

    def section(s: Column) -> Column:
        level = F.coalesce(F.nullif(F.length(F.regexp_extract(s["heading"], "^(#{1,6})\\s", 1)), F.lit(0)), F.lit(2))
        mark = F.when(s["new_page"], F.format_string('<div class="page-marker" id="page-%d">Page %d</div>', s["page_number"], s["page_number"]))
        return F.array(
            mark if o.pages else F.lit(None).cast("string"),
            F.when(s["heading"] != "", F.format_string("<h%d>%s</h%d>", level, escape_html(_title(s["heading"])), level)),
            F.when(s["body"] != "", body_html(strip(s["body"]))),
        )

    return F.array_join(F.concat(_block(True, head), _block(o.confidence, note), _block(o.toc, toc), _sections(section), F.array(F.lit("</body>\n</html>\n"))), "\n")


#: Builders of one row each, by format; records of chunks are rows of their own.
FORMATS: dict[str, tuple[str, Callable[[Options], Column] | None]] = {
    "Markdown": (".md", markdown), "JSON": (".json", json_document), "HTML": (".html", html), "Plain Text": (".txt", plain_text), "AI-Ready Chunks": (".jsonl", None),
}


def extension_for(fmt: str) -> str:
    """Extension of a format, that of Markdown for an unknown one."""
    return FORMATS.get(fmt, FORMATS["Markdown"])[0]


def stem() -> Column:
    """The alias of a document, else the safe stem of its file."""
    return F.coalesce(F.nullif("alias", F.lit("")), safe_stem(F.col("source_file")))


def output_dir(root: str, subfolder: bool = True) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), stem()) if subfolder else F.lit(root.rstrip("/"))


def output_path(root: str, fmt: str = "Markdown", subfolder: bool = True) -> Column:
    """Path of a document's output."""
    return F.concat(output_dir(root, subfolder), F.lit("/"), stem(), F.lit(extension_for(fmt)))


def assets_dir(root: str, subfolder: bool = True) -> Column:
    """Folder of a document's pictures: its own, or one beside those of other documents."""
    return F.concat(output_dir(root, subfolder), F.lit("/assets")) if subfolder else F.concat(output_dir(root, False), F.lit("/assets/"), stem())


def assets_prefix(subfolder: bool = True) -> Column:
    """What links to pictures begin with."""
    return F.lit("assets/") if subfolder else F.concat(F.lit("assets/"), stem(), F.lit("/"))


def render(docs: DataFrame, fmt: str, root: str = "", o: Options = Options(), *, rules: Profile | None = None, subfolder: bool = True) -> DataFrame:  # noqa: B008
    """(doc_id, path, text) of assembled ``docs`` in a format; rules apply to Markdown only.  An unknown format is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}; one of {', '.join(FORMATS)}")
    path = output_path(root, fmt, subfolder)
    if FORMATS[fmt][1] is None:
        records = chunk_records(docs, o)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "json"))), lambda x: x["json"]), "\n")
        made = records.groupBy("doc_id").agg(F.concat(text, F.lit("\n")).alias("text"))
        return docs.select("doc_id", path.alias("path")).join(made, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    text = FORMATS[fmt][1](o)
    return docs.select("doc_id", path.alias("path"), (rules.apply(text) if rules and fmt == "Markdown" else text).alias("text"))


def write(docs: DataFrame, fmt: str, target: str, o: Options = Options(), *, overwrite: bool = False, **options) -> None:  # noqa: B008
    """Outputs as Parquet rows (doc_id, path, text); an existing target is an error unless overwritten."""
    render(docs, fmt, o=o, **options).write.mode("overwrite" if overwrite else "errorifexists").parquet(target)


def save(docs: DataFrame, fmt: str, root: str, o: Options = Options(), *, overwrite: bool = False, **options) -> DataFrame:  # noqa: B008
    """Every document as a file at its path below ``root``; (path, status, bytes, reason), a row for each.

    A document whose file is there already keeps it and has status ``exists``,
    unless ``overwrite``; see ``sinks.files.write_files``.
    """
    return write_files(render(docs, fmt, "", o, **options).select("path", "text"), root, overwrite)


def chunk_records(docs: DataFrame, o: Options = Options(), size: int = 512, overlap: int = 50) -> DataFrame:  # noqa: B008
    """(doc_id, chunk_index, json): a JSON line for each section-aware chunk of assembled ``docs``."""
    rows = docs.select("doc_id", stem().alias("stem"), base_name(F.col("source_file")).alias("source"), F.col("confidence.overall").alias("overall"), F.inline("sections"))
    parts = section_chunks(rows, size, overlap, keep=["stem", "source", "overall", "heading", "page_number"])
    out = numbered(parts, "doc_id", ["sec_no", "k"], F.col("stem"))
    meta = F.struct(
        "source", "chunk_index", "total_chunks", F.col("page_number").alias("page"), F.when(F.col("heading") != "", _title(F.col("heading"))).alias("heading"),
        *([F.col("overall").alias("confidence")] if o.confidence else []),
    )
    return out.select("doc_id", "chunk_index", F.to_json(F.struct("id", F.col("chunk").alias("text"), meta.alias("metadata"))).alias("json"))


def markdown_cell(c: Column) -> Column:
    """A cell of a Markdown table: pipes escaped, line ends as spaces, null empty."""
    return F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def table_rows(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as a line of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns or df.columns]), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """An array of rows (arrays of cells), the first of them the header, as a Markdown table; short rows are padded."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), markdown_cell), " | "), F.lit(" |"))
    ruler = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.coalesce(width, F.lit(0)) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(ruler), F.slice(lines, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")).otherwise("")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def table_section(rows: DataFrame, cap: int = ROWS) -> DataFrame:
    """(doc_id, body): rows (doc_id, row_no, cells; row 0 is the header) as a table below a line of its size.

    The first ``cap`` rows are shown, which is a feature of the output; a note
    tells how many are not.  They are filtered by number before the shuffle, so a
    long table costs no more than its count.
    """
    total = rows.where("row_no > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shown = rows.where(F.col("row_no") <= cap).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda r: r["cells"]).alias("rows"))
    n = F.coalesce("n", F.lit(0))
    meta = F.concat(F.lit("*Rows: "), thousands(n), F.lit("  Columns: "), F.size(F.col("rows")[0]).cast("string"), F.lit("*"))
    note = F.when(n > cap, F.concat(F.lit("> **Note:** This file contains "), thousands(n), F.lit(f" rows. Only the first {cap:,} rows are shown below. ("), thousands(n - cap), F.lit(" rows omitted.)")))
    return shown.join(total, "doc_id", "left").select("doc_id", F.concat_ws("\n\n", meta, note, markdown_table(F.col("rows"))).alias("body"))


def capped(df: DataFrame, order: list[str], cap: int = ROWS) -> DataFrame:
    """The first ``cap`` rows in an order (a feature of table output), by a distributed top-k."""
    return df.orderBy(*order).limit(cap)


def page_anchors(sections: DataFrame) -> DataFrame:
    """Sections (with ``page_number``) at which the page changes."""
    before = Window.partitionBy("doc_id").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("page_number", ignorenulls=True).over(before)
    return sections.withColumn("_last", last).where(F.col("page_number").isNotNull() & ~F.col("page_number").eqNullSafe(F.col("_last"))).drop("_last")

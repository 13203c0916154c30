"""Queries of files, pictures, languages, labels and reports over the driver's tables, and their SQL.

Where an operator reads files, the query packs rows of a table into file contents
first, so that the reader itself runs over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import assets, chunking, confidence, language, layout, markup, postprocess, tables
from leafmill.plans import builders, reports
from leafmill.sources import dxf, files, html, office, pdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _file(path, content) -> list:
    return [path.alias("path"), content.alias("content")]


# Files -------------------------------------------------------------------------------------------


@query(
    """SELECT 'o' || o_orderkey || '.csv' AS path, 1 AS row_no, o_orderstatus || ', ' || o_orderpriority AS a, o_orderkey::VARCHAR AS b, 3 AS cells FROM orders"""
)
def csv_cells(spark, d):
    """Each order as a delimited file of its own, delimiter and encoding by its key: quoted cells, a mark at the start, Latin-1 signs."""
    o = _t(spark, d, "orders")
    sep = F.element_at(F.array(*map(F.lit, (";", ",", "\t"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    head = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("﻿")).otherwise(""), F.lit("name"), sep, F.lit("key"), sep, F.lit("prix"))
    row = F.concat(F.lit('\n"'), "o_orderstatus", F.lit(", "), "o_orderpriority", F.lit('"'), sep, "o_orderkey", sep, F.lit("été\n"))
    content = F.when(F.col("o_orderkey") % 2 == 0, F.encode(F.concat(head, row), "UTF-8")).otherwise(F.encode(F.concat(head, row), "ISO-8859-1"))
    rows = files.read_rows(o.select(*_file(F.concat(F.lit("o"), "o_orderkey", F.lit(".csv")), content)))
    c = F.col("cells")
    return rows.where((F.col("row_no") == 1) & (c[2] == "été")).select("path", "row_no", c[0].alias("a"), c[1].alias("b"), F.size("cells").alias("cells"))


ROUTED = ".html .HTM .csv .rtf .dxf .pdf .txt".split()


@query(
    """SELECT ext, status, n, CASE ext WHEN '.csv' THEN n WHEN '.html' THEN n WHEN '.htm' THEN n WHEN '.rtf' THEN n WHEN '.dxf' THEN n ELSE 0 END AS with_text, error FROM (
  SELECT ext, CASE WHEN ext IN ('.pdf', '.txt') THEN 'failed' ELSE 'ok' END AS status, CASE ext WHEN '.pdf' THEN 'not a PDF file' WHEN '.txt' THEN 'unsupported file type: .txt' END AS error, count(*) AS n
  FROM (SELECT ['.html', '.htm', '.csv', '.rtf', '.dxf', '.pdf', '.txt'][event_id % 7 + 1] AS ext FROM events) GROUP BY ext)"""
)
def routed_files(spark, d):
    """Events as files of seven kinds, in upper and lower case, each through the reader of its kind."""
    kind = (F.col("event_id") % 7).cast("int")
    name = F.col("event_type")
    content = F.element_at(
        F.array(
            F.concat(F.lit("<p>"), name, F.lit("</p>")), F.concat(F.lit("<h1>"), name, F.lit("</h1>")), F.concat(F.lit("a,b\n"), name, F.lit(",1\n")), F.concat(F.lit("{\\rtf1 "), name, F.lit("\\par}")),
            F.concat(F.lit("0\nSECTION\n2\nENTITIES\n0\nTEXT\n8\nL\n10\n1\n20\n2\n1\n"), name, F.lit("\n0\nENDSEC\n0\nEOF\n")), name, name,
        ),
        kind + 1,
    )
    paths = F.concat(F.lit("in/e"), "event_id", F.element_at(F.array(*map(F.lit, ROUTED)), kind + 1))
    s = office.read_sections(_t(spark, d, "events").select("event_type", *_file(paths, content.cast("binary"))))
    kept = s.join(_t(spark, d, "events").select(paths.alias("path"), "event_type"), "path")
    return kept.groupBy(T.extension(F.col("path")).alias("ext"), "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.contains("body", "event_type")).alias("with_text"), F.min("error").alias("error")
    )


@query(r"SELECT doc_id, md5(regexp_replace(replace(regexp_replace(text, '[\\{}]', '', 'g'), e'\n', ' '), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS md5 FROM documents")
def rtf_text(spark, d):
    """Documents as RTF, signs beyond ASCII as numbered characters (of the basic plane), and read back."""
    plain = F.replace(F.translate("text", "\\{}", ""), F.lit("\n"), F.lit(" "))
    signs = F.split(F.regexp_replace("plain", "(?<=.)", "\u0000"), "\u0000")
    coded = F.array_join(F.transform(signs, lambda s: F.when(F.octet_length(s) > 1, F.concat(F.lit("\\u"), F.conv(F.hex(F.encode(s, "UTF-16BE")), 16, 10), F.lit("?"))).otherwise(s)), "")
    docs = _t(spark, d, "documents").select("doc_id", plain.alias("plain"))
    return docs.select("doc_id", F.md5(T.strip_rtf(F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}\\pard "), coded, F.lit("\\par}")))).alias("md5"))


@query("SELECT page_id, md5(replace(html, chr(13), '')) AS md5 FROM pages")
def decoded_pages(spark, d):
    """Pages as bytes, every other one with a byte order mark, decoded."""
    content = F.concat(F.when(F.col("page_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), F.encode("html", "UTF-8"))
    return _t(spark, d, "pages").select("page_id", F.md5(F.replace(html.decode_bytes(content), F.lit("\r"), F.lit(""))).alias("md5"))


@query("SELECT o_orderkey, o_orderkey % 5 + 1 AS pages, o_orderkey % 2 = 0 AS encrypted FROM orders")
def pdf_pages(spark, d):
    key = F.col("o_orderkey")
    body = F.concat(F.lit("%PDF-1.4\n<< /Type /Pages >>\n"), F.repeat(F.lit("<< /Type /Page >>\n"), (key % 5 + 1).cast("int")), F.when(key % 2 == 0, F.lit("trailer << /Encrypt 5 0 R >>")).otherwise(""))
    pdf = office.pdf_info(_t(spark, d, "orders").select(*_file(F.concat(F.lit("x"), key, F.lit(".PDF")), body.cast("binary"))))
    return pdf.select(F.regexp_extract("path", "\\d+", 0).cast("long").alias("o_orderkey"), F.col("pages").cast("long").alias("pages"), "encrypted")


def _pdfs(spark, d) -> DataFrame:
    """Documents as PDF files of 30 lines a page: ASCII lines as strings, others as UTF-16."""
    escaped = lambda x: F.concat(F.lit("("), F.regexp_replace(x, "([\\\\()])", "\\\\$1"), F.lit(") Tj T*"))
    line = lambda x: F.when(x.rlike("^[ -~]*$"), escaped(x)).otherwise(F.concat(F.lit("<FEFF"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj T*")))
    lines = F.split("text", "\n", -1)
    n = F.ceil(F.size(lines) / 30).cast("int")
    page = lambda k: F.concat(
        F.format_string("%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n%d 0 obj << >>\nstream\nBT\n", k * 2 + 3, k * 2 + 4, k * 2 + 4),
        F.array_join(F.transform(F.slice(lines, k * 30 + 1, 30), line), "\n"), F.lit("\nET\nendstream endobj\n"),
    )
    ks = F.sequence(F.lit(0), n - 1)
    kids = F.array_join(F.transform(ks, lambda k: F.format_string("%d 0 R", k * 2 + 3)), " ")
    head = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids ["), kids, F.lit("] >> endobj\n"))
    return _t(spark, d, "documents").select(*_file(F.concat(F.lit("d"), "doc_id", F.lit(".pdf")), F.concat(head, F.array_join(F.transform(ks, page), ""), F.lit("%%EOF")).cast("binary")))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n, len(ls) AS c FROM (SELECT doc_id, string_split(text, e'\n') AS ls FROM documents))
SELECT 'd' || doc_id || '.pdf' AS path, (n // 30 + 1)::INTEGER AS page_no, ((any_value(c) - 1) // 30 + 1)::INTEGER AS pages, md5(coalesce(string_agg(line, e'\n' ORDER BY n) FILTER (line <> ''), '')) AS md5 FROM l GROUP BY doc_id, n // 30"""
)
def pdf_texts(spark, d):
    """Pages of PDF files; lines without anything written leave none."""
    return pdf.read_pages(_pdfs(spark, d)).select("path", "page_no", "pages", F.md5("text").alias("md5"))


@query(
    """SELECT 'd' || doc_id || '.pdf' AS doc_id, ((len(ls) - 1) // 30 + 1)::INTEGER AS pages, 'High' AS text_extraction FROM (SELECT doc_id, text, string_split(text, e'\\n') AS ls FROM documents) WHERE len(ls) <= 30 AND regexp_matches(text, '[^\\s]')"""
)
def pdf_documents(spark, d):
    """Confidence of files of one page with text, from the whole page path."""
    sections, told = pdf.documents(_pdfs(spark, d))
    return told.join(sections.select("doc_id").distinct(), "doc_id", "left").where("pages = 1 AND text_extraction <> 'Failed'").select("doc_id", "pages", "text_extraction")


def _drawing(spark, d) -> DataFrame:
    """A drawing for each nation: a layer for it, and its suppliers as texts."""
    s = _t(spark, d, "supplier")
    one = F.concat(F.lit("0\nTEXT\n8\nN"), "s_nationkey", F.lit("\n10\n"), "s_suppkey", F.lit("\n20\n"), F.col("s_suppkey") % 3, F.lit("\n1\n"), "s_name", F.lit("\n"))
    texts = s.groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(one)), "").alias("x"))
    layer = F.concat(F.lit("0\nSECTION\n2\nTABLES\n0\nLAYER\n2\nN"), "s_nationkey", F.lit("\n62\n"), F.col("s_nationkey") % 9 - 2, F.lit("\n70\n"), F.col("s_nationkey") % 6, F.lit("\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n"))
    return texts.select(*_file(F.concat(F.lit("n"), "s_nationkey", F.lit(".dxf")), F.concat(layer, "x", F.lit("0\nENDSEC\n0\nEOF\n")).cast("binary")))


@query("SELECT 'n' || s_nationkey || '.dxf' AS path, 'N' || s_nationkey AS layer, array_to_string(list(s_name ORDER BY s_suppkey % 3 DESC, s_suppkey), ';') AS texts, count(*) AS n FROM supplier GROUP BY s_nationkey")
def drawing_texts(spark, d):
    e = dxf.read_entities(_drawing(spark, d)).where("kind = 'TEXT'")
    grouped = tables.text_by_layer(e.withColumn("layer", F.struct("path", "layer")))
    return grouped.select("layer.path", "layer.layer", F.array_join("texts", ";").alias("texts"), F.size("texts").cast("long").alias("n"))


@query(
    """WITH l AS (SELECT DISTINCT s_nationkey, (s_nationkey % 9 - 2)::INTEGER AS c, (s_nationkey % 6)::INTEGER AS f FROM supplier)
SELECT 'N' || s_nationkey AS layer, ['0', 'Red', 'Yellow', 'Green', 'Cyan', 'Blue', 'Magenta'][abs(c) + 1] AS colour,
  coalesce(nullif(concat_ws(', ', CASE WHEN c < 0 THEN 'Off' END, CASE WHEN f & 1 > 0 THEN 'Frozen' END, CASE WHEN f & 4 > 0 THEN 'Locked' END), ''), 'Active') AS status FROM l"""
)
def drawing_layers(spark, d):
    return dxf.read_layers(_drawing(spark, d)).select("layer", "colour", "status")


@query("SELECT path, min(struct_pack(part := part, ord := ord)).part AS part, min(struct_pack(part := part, ord := ord)).ord AS ord FROM (SELECT 'f' || (o_custkey % 50) AS path, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS part, o_orderkey AS ord FROM orders) GROUP BY path")
def chosen_files(spark, d):
    o = _t(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("path"), F.col("o_orderkey").alias("ord"))
    return files.add_files(o.where("ord % 2 = 0"), o.where("ord % 2 = 1"))


@query("SELECT url AS path FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def files_not_listed(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return files.not_listed(p.where("page_id % 3 <> 0").select("path"), p.where("page_id % 3 = 0"))


@query("SELECT o_orderkey, list_transform(['a.pdf', 'b ' || o_orderkey || '.docx', 'c.csv'], lambda x: x) AS paths FROM orders")
def dropped_lists(spark, d):
    text = F.concat(F.lit("a.pdf {b "), "o_orderkey", F.lit(".docx} c.csv"))
    return _t(spark, d, "orders").select("o_orderkey", files.dropped_paths(text).alias("paths"))


# Pictures ----------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT page_id, unnest(['img/a' || page_id % 3 || '.png', '../x/b.png', './../c.png', 'no.png', '']) AS src FROM pages),
i AS (SELECT page_id, unnest(['img/a1.png', 'b.png', 'c.png']) AS name, unnest(['assets/1', 'assets/2', 'assets/3']) AS path FROM pages)
SELECT r.page_id AS doc_id, src, coalesce(a.path, b.path, c.path) AS path FROM r LEFT JOIN i a ON a.page_id = r.page_id AND a.name = src LEFT JOIN i b ON b.page_id = r.page_id AND b.name = regexp_extract(src, '([^/]*)$', 1) AND src <> ''
LEFT JOIN i c ON c.page_id = r.page_id AND c.name = regexp_replace(src, '^(\\.\\.?/)+', '')"""
)
def resolved_images(spark, d):
    p = _t(spark, d, "pages").select(F.col("page_id").alias("doc_id"))
    src = F.array(F.concat(F.lit("img/a"), F.col("doc_id") % 3, F.lit(".png")), *map(F.lit, ("../x/b.png", "./../c.png", "no.png", "")))
    images = p.select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f"assets/{k}").alias("path")) for k, n in enumerate(("img/a1.png", "b.png", "c.png"), 1)])))
    return assets.resolve_images(p.select("doc_id", F.explode(src).alias("src")), images)


@query("SELECT doc_id, 'assets/p' || doc_id % 7 || '.png' AS src FROM documents WHERE doc_id % 7 > 2")
def missing_images(spark, d):
    text = F.concat(F.lit("![a](assets/p"), F.col("doc_id") % 7, F.lit(".png) ![w](https://h/x.png) ![d](data:image/png;base64,AA) "), F.regexp_replace("text", "[!\\[]", ""))
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("out/"), F.lit("./d/../"), "lang").alias("folder"), text.alias("text"))
    there = docs.select(F.explode(F.array(*[F.concat(F.lit("out/"), F.regexp_extract("folder", "[^/]*$", 0), F.lit(f"/assets/p{k}.png")) for k in range(3)])).alias("path")).distinct()
    return assets.missing_images(docs, there)


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/s/x/a.png' WHEN 1 THEN '/s/b' END AS path FROM pages")
def guarded_paths(spark, d):
    target = F.element_at(F.array(*map(F.lit, ("./x//a.png", "x/y/../../b", "../a.png", "https://h/a.png"))), (F.col("page_id") % 4 + 1).cast("int"))
    return _t(spark, d, "pages").select("page_id", assets.inside(F.lit("/s/t/.."), target).alias("path"))


@query(
    """WITH f AS (SELECT 'out/' || c_custkey || '.md' AS path, c_custkey::VARCHAR AS stem FROM customer), r AS (SELECT o_custkey::VARCHAR AS stem, o_orderstatus AS overall, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT path, CASE WHEN overall IS NOT NULL THEN 'in/' || f.stem || '.pdf' END AS source_file, overall FROM f LEFT JOIN r ON f.stem = r.stem AND n = 1"""
)
def results_by_stem(spark, d):
    outputs = _t(spark, d, "customer").select(F.concat(F.lit("out/"), "c_custkey", F.lit(".md")).alias("path"))
    results = _t(spark, d, "orders").select(F.concat(F.lit("in/"), "o_custkey", F.lit(".pdf")).alias("source_file"), F.col("o_orderstatus").alias("overall"), F.col("o_orderkey").alias("ord"))
    return assets.by_stem(outputs, results).select("path", "source_file", "overall")


@query(
    """WITH s AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), r AS (SELECT conv_id, turn + 2 AS page, 'ref' || turn AS ref FROM conversations),
a AS (SELECT s.conv_id, least(page - 1, last) AS seg, page, ref FROM r JOIN (SELECT DISTINCT conv_id, last FROM s) s USING (conv_id)), g AS (SELECT conv_id, seg, string_agg(ref, e'\\n' ORDER BY page) AS refs FROM a GROUP BY conv_id, seg)
SELECT s.conv_id AS doc_id, turn AS seg_no, md5(concat_ws(e'\\n', text, refs)) AS md5 FROM s LEFT JOIN g ON s.conv_id = g.conv_id AND turn = seg"""
)
def attached_images(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    refs = c.select("doc_id", (F.col("turn") + 2).alias("page"), F.lit(0).alias("ord"), F.concat(F.lit("ref"), "turn").alias("ref"))
    return assets.attach_images(c.withColumnRenamed("turn", "seg_no"), refs).select("doc_id", "seg_no", F.md5("text").alias("md5"))


@query(
    """SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN replace(text, '<!--', '') || '<!-- image --> and <!--IMAGE-->' ELSE replace(text, '<!--', '') || '![Image 1 — page 4](data:image/png;base64,' || base64(encode('p' || doc_id)) || ') and '
  || CASE doc_id % 3 WHEN 1 THEN '<!--IMAGE-->' ELSE '*[image — could not be extracted]*' END END) AS md5 FROM documents"""
)
def embedded_images(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.replace("text", F.lit("<!--"), F.lit("")), F.lit("<!-- image --> and <!--IMAGE-->")).alias("text"))
    one = F.struct(F.lit(1).alias("ord"), F.lit(4).alias("page"), F.concat(F.lit("p"), "doc_id").cast("binary").alias("content"))
    lost = lambda k: F.struct(F.lit(k).alias("ord"), F.lit(5).alias("page"), F.lit(None).cast("binary").alias("content"))
    pictures = docs.select("doc_id", F.inline(F.when(F.col("doc_id") % 3 == 1, F.array(one)).when(F.col("doc_id") % 3 == 2, F.array(lost(3), one, lost(2)))))
    return assets.embed_images(docs, pictures).select("doc_id", F.md5("text").alias("md5"))


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS item_id FROM lineitem), n AS (SELECT doc_id, item_id, 10 - item_id AS pos FROM i WHERE doc_id % 3 <> 0 AND item_id % 2 = 1)
SELECT * FROM n UNION ALL SELECT doc_id, item_id, item_id AS pos FROM i WHERE doc_id NOT IN (SELECT doc_id FROM n)"""
)
def spine_items(spark, d):
    items = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("item_id")).distinct().withColumn("ord", F.col("item_id"))
    spine = items.where("doc_id % 3 <> 0 AND item_id % 2 = 1").select("doc_id", (10 - F.col("item_id")).alias("pos"), "item_id")
    return assets.spine_order(spine, items).select("doc_id", "item_id", "pos")


@query("SELECT conv_id AS doc_id, turn AS page_no FROM conversations WHERE turn <= 1")
def preview_pages(spark, d):
    pages = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"))
    return postprocess.first_pages(pages, 1)


@query(
    """SELECT source AS path, doc_id, 'image_' || lpad(n::VARCHAR, 3, '0') || '.' || e AS file, '![Image ' || n || '](assets/image_' || lpad(n::VARCHAR, 3, '0') || '.' || e || ')' AS link FROM (
  SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY n) AS r FROM (SELECT source, doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'gif' ELSE 'png' END AS e,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)) WHERE r = 1"""
)
def named_images(spark, d):
    return picture_rows(spark, d).select("path", "doc_id", "file", "link")


def picture_rows(spark, d) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "x.jpeg").when(F.col("doc_id") % 3 == 1, "/.none").otherwise("y.png")
    images = _t(spark, d, "documents").select(
        F.col("source").alias("path"), "doc_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), kind).alias("name"), F.lit("image/gif").alias("media_type"), F.col("text").cast("binary").alias("content"), F.lit(0).alias("image_no")
    )
    return assets.named_images(images)


@query(
    """WITH a AS (SELECT o_custkey AS c, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS c, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O')
SELECT a.c AS doc_id, o_orderkey, o_orderpriority FROM a LEFT JOIN b ON a.c = b.c AND a.n = b.n"""
)
def zipped_rows(spark, d):
    o = _t(spark, d, "orders").withColumnRenamed("o_custkey", "doc_id")
    right = o.where("o_orderstatus = 'O'").select("doc_id", F.col("o_orderkey").alias("k"), "o_orderpriority")
    return assets.zip_by_position(o.where("o_orderstatus = 'F'").select("doc_id", "o_orderkey"), right, "doc_id", "o_orderkey", "k")


# Labels and layout -------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity * 2 >= 85 THEN 'High' WHEN l_quantity * 2 >= 60 THEN 'Medium' ELSE 'Low' END AS accuracy,
  CASE WHEN r = 0 THEN 'High' WHEN r::DOUBLE / greatest(l_quantity, 1) < 0.1 THEN 'Medium' ELSE 'Low' END AS workbook FROM (SELECT *, l_linenumber - 1 AS r FROM lineitem)"""
)
def table_labels(spark, d):
    r = F.col("l_linenumber") - 1
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", confidence.accuracy_label(F.col("l_quantity") * 2).alias("accuracy"), confidence.workbook_label(r, F.col("l_quantity").cast("double")).alias("workbook")
    )


@query(
    """SELECT user_id, arg_min(label, r) AS label FROM (SELECT user_id, ['High', 'N/A', 'Medium', 'odd'][event_id % 4 + 1] AS label, [3, 4, 2, 0][event_id % 4 + 1] AS r FROM events) GROUP BY user_id"""
)
def worst_pages(spark, d):
    label = F.element_at(F.array(*map(F.lit, ("High", "N/A", "Medium", "odd"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, d, "events").groupBy("user_id").agg(confidence.worst_page(label).alias("label"))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Medium' ELSE 'Low' END AS text, CASE o_orderstatus WHEN 'F' THEN 'N/A' WHEN 'O' THEN 'Medium' ELSE 'Low' END AS ocr, o_orderstatus <> 'F' AS review,
  CASE o_orderstatus WHEN 'O' THEN 'Some pages could not be OCR''d. Review the output.' WHEN 'P' THEN 'ocrmypdf returned exit code: P' END AS warning FROM orders"""
)
def exit_codes(spark, d):
    code = F.when(F.col("o_orderstatus") == "F", "already_done_ocr").when(F.col("o_orderstatus") == "O", "some_pages_had_errors").otherwise(F.col("o_orderstatus"))
    return _t(spark, d, "orders").select("o_orderkey", confidence.exit_confidence(code).alias("c")).select(
        "o_orderkey", F.col("c.text_extraction").alias("text"), F.col("c.ocr_confidence").alias("ocr"), F.col("c.manual_review_recommended").alias("review"), "c.warning"
    )


@query(
    """SELECT doc_id, line_num, string_agg(l_returnflag, ' ' ORDER BY n) AS text, round(avg(l_discount), 6) AS conf FROM (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS line_num, l_returnflag, l_discount,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem) GROUP BY doc_id, line_num"""
)
def reader_lines(spark, d):
    n = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)")
    words = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), n.alias("word_id"), (F.col("l_linenumber") % 3).alias("line_num"), F.col("l_returnflag").alias("text"), F.col("l_discount").alias("conf"))
    return layout.numbered_lines(words).select("doc_id", "line_num", "text", F.round("conf", 6).alias("conf"))


@query(
    r"""SELECT doc_id, string_agg(t, e'\n\n' ORDER BY c, y, n) AS text FROM (SELECT l_orderkey AS doc_id, l_partkey % 2 AS c, l_suppkey % 4 AS y, l_partkey || l_returnflag AS t, l_linestatus,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem) WHERE l_linestatus = 'O' GROUP BY doc_id"""
)
def reading_order(spark, d):
    n = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)")
    blocks = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), n.alias("block_no"), (F.col("l_partkey") % 2).alias("col_no"), (F.col("l_suppkey") % 4).alias("y0"),
        F.concat("l_partkey", "l_returnflag").alias("text"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("kind"),
    )
    return layout.reading_order(layout.text_blocks(blocks)).select("doc_id", "text")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc_id, string_split(text, e'\n') AS ls FROM documents))
SELECT doc_id, md5(string_agg(CASE WHEN length(trim(line)) BETWEEN 1 AND 60 THEN repeat('#', (length(trim(line)) % 3 + 2)::INTEGER) || ' ' || trim(line) ELSE line END, e'\n' ORDER BY n)) AS md5 FROM l GROUP BY doc_id"""
)
def marked_headings(spark, d):
    pages = _t(spark, d, "documents").select("doc_id", F.lit(1).alias("page_no"), "text")
    lines = T.explode_lines(pages, ["doc_id", "page_no"], newline_only=True).select("doc_id", "page_no", F.col("pos").alias("line_id"), F.trim("line").alias("text"))
    found = lines.where(F.length("text").between(1, 60)).withColumn("level", (F.length("text") % 3 + 2).cast("int"))
    return layout.mark_headings(pages, found).select("doc_id", F.md5("text").alias("md5"))


@query(r"SELECT doc_id, '<a id=@page-1@></a>' AS first, len(regexp_extract_all(e'a\n---\n' || text || e'\n----', '(?m)^-{3,}\s*$'))::INTEGER + 1 AS marks FROM documents".replace("@", '"'))
def injected_anchors(spark, d):
    docs = markup.page_anchors(_t(spark, d, "documents").select("doc_id", F.concat(F.lit("a\n---\n"), "text", F.lit("\n----")).alias("text")))
    return docs.select("doc_id", F.substring("text", 1, 19).alias("first"), F.regexp_count("text", F.lit('<a id="page-\\d+"></a>')).alias("marks"))


@query(
    """WITH s AS (SELECT conv_id, turn, role, length('- ') AS a FROM conversations)
SELECT conv_id, turn, 2 AS bullet_end, 2 + 4 + length(role) AS code_start, 2 + 4 + length(role) + 3 AS code_end, 2 AS bold_start, 2 + 4 + length(role) AS bold_end, 2 + 4 + length(role) + 3 + 1 AS link_start FROM s"""
)
def inline_spans(spark, d):
    line = F.concat(F.lit("- **"), "role", F.lit("**`x` [l](u)"))
    at = lambda kind: markup.spans(line, kind)[0]
    return _t(spark, d, "conversations").select(
        "conv_id", "turn", at("list_bullet")["end"].alias("bullet_end"), at("inline_code")["start"].alias("code_start"), at("inline_code")["end"].alias("code_end"), at("bold")["start"].alias("bold_start"),
        at("bold")["end"].alias("bold_end"), at("link")["start"].alias("link_start"),
    )


# Tables and texts --------------------------------------------------------------------------------


@query(
    r"""WITH r AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, '| ' || o_orderkey || ' | ' || o_orderstatus || '\|x |  |' AS line FROM orders), t AS (SELECT doc_id, count(*) AS c FROM r GROUP BY doc_id)
SELECT doc_id, md5(concat_ws(e'\n\n', '*Rows: ' || any_value(c) || '  Columns: 3*', CASE WHEN any_value(c) > 5 THEN '> **Note:** This file contains ' || any_value(c) || ' rows. Only the first 5 rows are shown below. (' || (any_value(c) - 5) || ' rows omitted.)' END,
  e'| key | status | more |\n| --- | --- | --- |\n' || string_agg(line, e'\n' ORDER BY n))) AS md5 FROM r JOIN t USING (doc_id) WHERE n <= 5 GROUP BY doc_id"""
)
def table_sections(spark, d):
    """Orders of a customer as a table of five rows at most, with a note on the others; short rows are padded."""
    n = F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), n.alias("row_no"), F.array(F.col("o_orderkey").cast("string"), F.concat("o_orderstatus", F.lit("|x"))).alias("cells"))
    head = rows.select("doc_id").distinct().select("doc_id", F.lit(0).alias("row_no"), F.array(*map(F.lit, ("key", "status", "more"))).alias("cells"))
    return builders.table_section(rows.unionByName(head), cap=5).select("doc_id", F.md5("body").alias("md5"))


@query("SELECT source AS doc_id, md5(string_agg(text, chr(12) ORDER BY doc_id)) AS md5 FROM documents GROUP BY source")
def merged_sidecars(spark, d):
    chunks = _t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_no"), "text")
    return chunking.sidecar_text(chunks).select("doc_id", F.md5("text").alias("md5"))


@query(
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE upper(lang) END AS name,
  CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE 'eng' END AS ocr, CASE WHEN lang IN ('de', 'fr', 'es') THEN lang ELSE 'en' END AS code FROM documents"""
)
def language_names(spark, d):
    return _t(spark, d, "documents").select("doc_id", language.language_name(F.col("lang")).alias("name"), language.ocr_code(F.col("lang")).alias("ocr"), language.chosen_code(language.language_name(F.col("lang"))).alias("code"))


COUNTS_SQL = ", ".join(f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in words.split())}))) AS {lang}_" for lang, words in language.FREQUENT.items())
LANGS_SQL = ", ".join(f"{{n: {lang}_, lang: '{lang}'}}" for lang in sorted(language.FREQUENT))


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_split_to_array(t, '[^\p{{L}}]+') AS ws, length(t) AS c FROM (SELECT doc_id, lower(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS t FROM documents)),
n AS (SELECT doc_id, c, {COUNTS_SQL} FROM t), l AS (SELECT doc_id, c, [{LANGS_SQL}] AS xs FROM n),
b AS (SELECT doc_id, c, list_filter(xs, lambda x: x.n = list_max(list_transform(xs, lambda y: y.n)))[1] AS x, list_sum(list_transform(xs, lambda y: y.n)) AS total FROM l)
SELECT doc_id, CASE WHEN c < 20 OR total = 0 THEN 'en' ELSE x.lang END AS lang, CASE WHEN c < 20 OR total = 0 THEN 0.0 ELSE round(x.n::DOUBLE / total, 6) END::DOUBLE AS score FROM b"""
)
def detected_languages(spark, d):
    found = language.detect(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", found["lang"].alias("lang"), F.round(found["score"], 6).alias("score"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls)))::INTEGER AS pos FROM (SELECT doc_id, string_split(text, e'\n') AS ls FROM documents)),
t AS (SELECT *, regexp_replace(CASE WHEN pos % 2 = 0 THEN line || 'x' ELSE line END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM l)
SELECT doc_id, pos, CASE WHEN doc_id % 3 = 2 THEN CASE WHEN pos = 0 THEN 'whole' END WHEN t <> '' AND lower(t) <> lower(line) THEN t END AS translation FROM t"""
)
def translated_pairs(spark, d):
    """Every other line with a sign more as its translation, the others as they are; for every third document a translation of another number of lines."""
    other = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 2 == 0, F.concat(x, F.lit("x"))).otherwise(x)), "\n")
    many = F.when(F.contains("text", F.lit("\n")), F.lit("whole")).otherwise(F.lit("whole\n\n"))
    docs = _t(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 2, many).otherwise(other).alias("translated"))
    return language.paired_lines(docs).select("doc_id", "pos", "translation")


# Reports -----------------------------------------------------------------------------------------


def _results(spark, d) -> DataFrame:
    high, low = F.when(F.col("quality") == 1, "High").otherwise("Low"), F.lit("N/A")
    return _t(spark, d, "labels").select(
        F.concat(F.lit("in/d"), "doc_id", F.lit(".pdf")).alias("file"), *[(high if k == 0 else low).alias(x) for k, x in enumerate(confidence.DIMENSIONS)], (F.col("toxic") == 1).alias("manual_review_recommended"),
        F.array(F.lit("w")).alias("warnings"),
    )


@query(
    """SELECT 'in/d' || doc_id || '.pdf' AS file, 'd' || doc_id || '.pdf' AS name, '.pdf' AS extension, CASE WHEN doc_id % 5 = 0 THEN 'failed: x' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 5 = 0 THEN 'Failed' WHEN quality = 1 THEN 'High' WHEN quality = 0 THEN 'Low' ELSE 'N/A' END AS overall, CASE WHEN doc_id % 5 = 0 OR quality = 0 THEN '▼' WHEN quality = 1 THEN '▲' ELSE '–' END AS badge,
  coalesce(toxic = 1, false) AS review, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS n_warnings, NULL::BIGINT AS headings, n_chars::BIGINT AS words, 'x' AS grade_label FROM documents LEFT JOIN labels USING (doc_id)"""
)
def batch_results(spark, d):
    name = F.concat(F.lit("in/d"), "doc_id", F.lit(".pdf")).alias("file")
    docs = _t(spark, d, "documents")
    listed = docs.select(name, F.when(F.col("doc_id") % 5 == 0, "failed: x").otherwise("ok").alias("status"))
    validated = docs.select(name, F.lit(None).cast("long").alias("heading_count"), F.col("n_chars").cast("long").alias("word_count"), F.lit("x").alias("grade_label"))
    return reports.results(listed, _results(spark, d), validated)


@query(
    r"""SELECT 'in/d' || doc_id || '.pdf' AS file, 'out/d' || doc_id || '/conversion.log' AS path, md5(e'1 [INFO] start\n2 [WARN] q' || quality || e'\n') AS md5 FROM labels
UNION ALL SELECT 'in/d' || doc_id || '.pdf', 'out/d' || doc_id || '/confidence_report.txt', md5('Overall: ' || l || e'\nText extraction: ' || l || e'\nTable structure: N/A\nImage extraction: N/A\nImage placement: N/A\nDocument order: N/A\nManual review recommended: ' || CASE toxic WHEN 1 THEN 'Yes' ELSE 'No' END)
FROM (SELECT *, CASE quality WHEN 1 THEN 'High' ELSE 'Low' END AS l FROM labels)"""
)
def file_artifacts(spark, d):
    return artifact_rows(spark, d).select("file", "path", F.md5("text").alias("md5"))


def artifact_rows(spark, d) -> DataFrame:
    logs = _t(spark, d, "labels").select(F.concat(F.lit("in/d"), "doc_id", F.lit(".pdf")).alias("file"), F.inline(F.array(
        F.struct(F.lit(2).alias("at"), F.lit("WARN").alias("level"), F.concat(F.lit("q"), "quality").alias("message")), F.struct(F.lit(1).alias("at"), F.lit("INFO").alias("level"), F.lit("start").alias("message")))))
    return reports.artifacts(_results(spark, d), logs, "out/")


@query("SELECT '.' || lower(event_type) AS extension, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS files, sum(event_id)::BIGINT AS bytes, max(value) AS slowest FROM events GROUP BY 1, 2")
def run_diagnostics(spark, d):
    rows = _t(spark, d, "events").select(F.concat(F.lit("f."), F.upper("event_type")).alias("file"), F.when(F.col("event_id") % 4 == 0, "failed").otherwise("ok").alias("status"), F.col("event_id").alias("length"), F.col("value").alias("seconds"))
    return reports.diagnostics(rows)


@query(
    """SELECT c_custkey, 'out/' || n || '/' || n || '.jsonl' AS path, 'out/assets/' || n AS assets, 'assets/' || n || '/' AS prefix FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey ELSE 'x_' || c_custkey END AS n FROM customer)"""
)
def output_paths(spark, d):
    docs = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("in/x:"), "c_custkey", F.lit(".docx")).alias("source_file"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("a"), "c_custkey")).otherwise("").alias("alias"))
    return docs.select("c_custkey", builders.output_path("out/", "AI-Ready Chunks").alias("path"), builders.assets_dir("out", False).alias("assets"), builders.assets_prefix(False).alias("prefix"))

"""Queries of the structure and table operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import confidence, layout, markup, tables
from leafmill.plans import builders
from leafmill.sources import files

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


HEAD, TAIL = '---\ntitle: x\n---\n# One\n\n<a id="page-1"></a>\n## Two\n```py\n# code\n```\n| a |\n> q\n![i](a.png)\n***\n', "\n### Three\n---\n*Page 2*\n"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Documents with front matter, headings, code, a table, a quote, an image and rules around their text."""
    return _t(spark, d, "documents").select("doc_id", F.concat(F.lit(HEAD), "text", F.lit(TAIL)).alias("text"))


LINES_SQL = f"""lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls)))::INTEGER AS pos FROM (SELECT doc_id, string_split('{HEAD}' || text || '{TAIL}', e'\\n') AS ls FROM documents))"""
CLASSES_SQL = (
    "WITH "
    + LINES_SQL
    + r""", t AS (SELECT *, regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM lines),
r AS (SELECT *, sum((t <> '')::INT) OVER w AS fill, sum((t = '---')::INT) OVER w AS rules FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT *, max((t = '---' AND fill = 1)::INT) OVER (PARTITION BY doc_id) = 1 AND (rules = 1 OR (rules = 2 AND t = '---')) AS matter FROM r),
f AS (SELECT *, sum((NOT matter AND starts_with(t, '```'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 OR (NOT matter AND starts_with(t, '```')) AS code FROM m),
c AS (SELECT doc_id, pos, line, CASE WHEN matter THEN 'frontmatter' WHEN code THEN 'code_block' WHEN regexp_full_match(t, '-{3,}|\*{3,}|_{3,}') THEN 'hr'
  WHEN starts_with(line, '# ') THEN 'heading' WHEN starts_with(line, '## ') THEN 'heading2' WHEN regexp_matches(line, '^#{3,6} ') THEN 'heading3' WHEN starts_with(t, '|') THEN 'table'
  WHEN starts_with(t, '*Page ') OR contains(line, '<a id="page-') THEN 'page_marker' WHEN starts_with(t, '> ') OR t = '>' THEN 'blockquote'
  WHEN regexp_matches(t, '^!\[[^\]]*\]\([^)]+\)') THEN 'image_ref' ELSE 'text' END AS kind FROM f)
"""
)


@query(CLASSES_SQL + "SELECT doc_id, kind, count(*) AS n FROM c GROUP BY doc_id, kind")
def line_class_counts(spark, d):
    return markup.line_classes(_marked(spark, d)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    CLASSES_SQL
    + """, n AS (SELECT *, coalesce(kind <> lag(kind) OVER (PARTITION BY doc_id ORDER BY pos), true) AS new FROM c),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS run_no FROM n)
SELECT doc_id, run_no, kind, min(pos) AS first, max(pos) AS last FROM g GROUP BY doc_id, run_no, kind"""
)
def line_class_runs(spark, d):
    return markup.runs(markup.line_classes(_marked(spark, d)))


@query("WITH " + LINES_SQL + r""" SELECT doc_id, pos AS ord, length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1))::INTEGER AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2)) AS title FROM lines WHERE regexp_matches(line, '^(#{1,6})\s+(.+)$')""")
def toc_entries(spark, d):
    return markup.toc_entries(_marked(spark, d))


@query(
    "WITH "
    + LINES_SQL
    + r""", e AS (SELECT doc_id, pos, repeat('  ', length(regexp_extract(line, '^(#{1,6})\s', 1))::INTEGER - 1) || '- [' || trim(regexp_extract(line, '^#{1,6}\s+(.+)$', 1)) || '](#)' AS x FROM lines WHERE regexp_matches(line, '^#{1,6}\s+.'))
SELECT doc_id, e'## Table of Contents\n\n' || string_agg(x, e'\n' ORDER BY pos) || e'\n\n---' AS toc FROM e GROUP BY doc_id"""
)
def toc_blocks(spark, d):
    return builders.contents(markup.toc_entries(_marked(spark, d)).withColumn("page", F.lit(None).cast("int")))


@query(
    r"""SELECT page_id, e'---\ntitle: "' || regexp_replace(s, '(.)\.[^.]*$', '\1') || e'"\nsource: "' || s || e'"\nconverted: 2026-01-01\nmarkdown_flavor: "GFM"\n---' AS matter FROM (SELECT page_id, replace(replace(replace(url, '"', ''''), e'\n', ' '), ':', ' -') AS s FROM pages)"""
)
def front_matter(spark, d):
    return _t(spark, d, "pages").select("page_id", builders.front_matter(F.col("url"), "2026-01-01").alias("matter"))


@query(r"SELECT doc_id, md5(regexp_replace('[top](#page-1) ![fig](assets/a.png) ' || text, '\[([^\]]+)\]\(((?:#|assets/)[^)]*)\)', '[[\2|\1]]', 'g')) AS md5 FROM documents")
def obsidian_links(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(builders.obsidian(F.concat(F.lit("[top](#page-1) ![fig](assets/a.png) "), "text"))).alias("md5"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(e'first\n---\n' || text || e'\n-----\nlast', e'\n') AS ls FROM documents)),
p AS (SELECT *, 1 + sum(regexp_matches(line, '^-{3,}\s*$')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS page_no FROM l)
SELECT doc_id, page_no::BIGINT AS page_no, md5(coalesce(string_agg(line, e'\n' ORDER BY pos) FILTER (NOT regexp_matches(line, '^-{3,}\s*$')), '')) AS md5 FROM p GROUP BY doc_id, page_no"""
)
def pages_by_rules(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("first\n---\n"), "text", F.lit("\n-----\nlast")).alias("text"))
    return markup.pages_by_rules(docs).select("doc_id", "page_no", F.md5("text").alias("md5"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(e'SCOPE OF WORK\n\n' || text || e'\n\n2.1 Details here\n\nlast line', e'\n') AS ls FROM documents)),
t AS (SELECT *, regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM l),
h AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY doc_id ORDER BY pos), '') = '' AND length(t) < 80 AND ((upper(t) = t AND lower(t) <> t AND length(t) > 2 AND NOT regexp_matches(t, '^[|\-=*]')) OR regexp_matches(t, '^\d+(\.\d+)*\.?\s+[A-Z]')) AS head FROM t),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS sec_no FROM h),
g AS (SELECT doc_id, sec_no, count(*) FILTER (head) AS heads, regexp_replace(coalesce(string_agg(t, e'\n' ORDER BY pos) FILTER (NOT head), ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS body FROM s GROUP BY doc_id, sec_no)
SELECT doc_id, sec_no, heads > 0 AS has_heading, md5(body) AS md5 FROM g WHERE heads > 0 OR body <> ''"""
)
def plain_sections(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("SCOPE OF WORK\n\n"), "text", F.lit("\n\n2.1 Details here\n\nlast line")).alias("text"))
    return markup.plain_sections(docs).select("doc_id", "sec_no", (F.col("heading") != "").alias("has_heading"), F.md5("body").alias("md5"))


@query(
    """SELECT doc_id, string_agg(CASE WHEN b AND i THEN '***' || x || '***' WHEN b THEN '**' || x || '**' WHEN i THEN '*' || x || '*' ELSE x END, '' ORDER BY run_no) AS text FROM (
  SELECT conv_id AS doc_id, turn AS run_no, text AS x, role = 'user' AS b, turn % 2 = 1 AS i FROM conversations WHERE text <> '') GROUP BY doc_id"""
)
def type_runs(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("run_no"), "text", (F.col("role") == "user").alias("bold"), (F.col("turn") % 2 == 1).alias("italic"))
    return markup.type_runs(rows, ["doc_id"])


@query("SELECT conv_id, turn, repeat('  ', turn::INTEGER) || '- ' || role AS item, '> ' || replace(text, e'\\n', e'\\n> ') AS note FROM conversations")
def bullets_and_notes(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", markup.bullet(F.col("role"), F.col("turn").cast("int")).alias("item"), markup.quote(F.col("text")).alias("note"))


@query("SELECT event_id, CASE WHEN event_id BETWEEN 1 AND 6 THEN event_id::INTEGER ELSE 3 END AS level FROM events")
def element_levels(spark, d):
    return _t(spark, d, "events").select("event_id", markup.element_level(F.concat("event_type", F.lit("_level_"), "event_id")).alias("level"))


@query("SELECT doc_id, md5('Ax *[image]*' || e'\\n\\n---\\n\\n' || replace(text, chr(173), '')) AS md5 FROM documents")
def clean_glyphs(spark, d):
    text = F.concat(F.lit("\uf741\u00adx <!-- IMAGE -->\ue048"), "text")
    return _t(spark, d, "documents").select("doc_id", F.md5(markup.clean_glyphs(text)).alias("md5"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes on a grid from all rows of lineitem, numbered within their order."""
    n = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)")
    x, y = (F.col("l_partkey") % 4) * 30.0, n * 20.0
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), n.alias("no"), "l_returnflag", "l_partkey", x.alias("x0"), y.alias("y0"), (x + 25).alias("x1"), (y + 12).alias("y1"))


@query(
    """WITH b AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS no, l_returnflag AS f, l_partkey AS p FROM lineitem),
j AS (SELECT i.doc_id, i.no AS image_id, 'Figure ' || c.p AS caption, c.no, abs(i.no - c.no) * 20.0 - 12 AS dist FROM b i JOIN b c ON i.doc_id = c.doc_id AND i.f = 'R' AND c.f <> 'R' AND i.p % 4 = c.p % 4)
SELECT doc_id, 1 AS page_no, image_id::INTEGER AS image_id, caption FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, image_id ORDER BY dist, no) AS r FROM j WHERE dist < 46) WHERE r = 1"""
)
def nearest_captions(spark, d):
    b = _boxes(spark, d)
    images = b.where("l_returnflag = 'R'").select("doc_id", "page_no", F.col("no").alias("image_id"), "x0", "y0", "x1", "y1")
    blocks = b.where("l_returnflag <> 'R'").select("doc_id", "page_no", F.col("no").alias("block_no"), "x0", "y0", "x1", "y1", F.concat(F.lit("Figure "), "l_partkey").alias("text"))
    return layout.captions(images, blocks)


@query(
    """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_id, l_returnflag || l_partkey AS text, l_quantity AS size, l_linestatus = 'O' AS bold,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS no FROM lineitem),
b AS (SELECT doc_id, median(size) AS base FROM s GROUP BY doc_id),
l AS (SELECT doc_id, line_id, string_agg(text, '' ORDER BY no) AS text, sum(size * length(text)) / greatest(sum(length(text)), 1) AS size, bool_and(bold) AS bold FROM s GROUP BY doc_id, line_id)
SELECT doc_id, 1 AS page_no, line_id, text, level FROM (SELECT *, CASE WHEN size / base >= 2.0 THEN 2 WHEN size / base >= 1.5 THEN 3 WHEN size / base >= 1.3 OR (bold AND size / base >= 1.15) THEN 4 END AS level FROM l JOIN b USING (doc_id))
WHERE level IS NOT NULL AND length(text) < 120"""
)
def sized_headings(spark, d):
    n = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)")
    spans = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("line_id"), n.alias("span_no"), F.concat("l_returnflag", "l_partkey").alias("text"), F.col("l_quantity").alias("size"), F.when(F.col("l_linestatus") == "O", 16).otherwise(0).alias("flags")
    )
    return layout.heading_levels(spans)


@query(
    """WITH c AS (SELECT n_regionkey AS sheet, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INTEGER AS row, unnest([1, 2]) AS col, unnest([n_nationkey::VARCHAR, n_name]) AS value FROM nation),
m AS (SELECT r_regionkey AS sheet, 1 AS r0, 1 AS c0, 2 AS r1, 2 AS c1 FROM region)
SELECT c.sheet, c.row, c.col, coalesce(t.value, c.value) AS value FROM c LEFT JOIN m ON c.sheet = m.sheet AND c.row BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1 LEFT JOIN c t ON t.sheet = m.sheet AND t.row = m.r0 AND t.col = m.c0"""
)
def merged_cells(spark, d):
    row = F.expr("row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)")
    cell = F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("n_nationkey").cast("string").alias("value")), F.struct(F.lit(2).alias("col"), F.col("n_name").alias("value"))))
    cells = _t(spark, d, "nation").select(F.col("n_regionkey").alias("sheet"), row.alias("row"), "n_nationkey", "n_name").select("sheet", "row", cell.alias("c")).select("sheet", "row", "c.*")
    merges = _t(spark, d, "region").select(F.col("r_regionkey").alias("sheet"), *[F.lit(v).alias(k) for k, v in (("min_row", 1), ("min_col", 1), ("max_row", 2), ("max_col", 2))])
    return layout.fill_merged(cells, merges)


@query("SELECT user_id, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN '' ELSE event_type END AS event_type FROM events")
def repeated_cells_blanked(spark, d):
    return tables.blank_repeats(_t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("SELECT source, doc_id, image_no::INTEGER AS image_no FROM (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY image_no) AS r FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS image_no FROM documents)) WHERE r = 1")
def numbered_images(spark, d):
    return tables.numbered_images(_t(spark, d, "documents").select("source", "doc_id", "text"), "source", ["doc_id"], "text").select("source", "doc_id", "image_no")


TAGS = {"1-URGENT": "Priority", "2-HIGH": "Priority", "3-MEDIUM": "Grade", "4-NOT SPECIFIED": "Grade", "5-LOW": "Grade"}


@query(
    """SELECT o_custkey, label, value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, label ORDER BY o_orderkey) AS r FROM (
  SELECT o_custkey, o_orderkey, o_orderstatus AS value, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Priority' WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') THEN 'Grade' END AS label FROM orders) WHERE label IS NOT NULL) WHERE r = 1"""
)
def title_blocks(spark, d):
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("tag"), F.col("o_orderstatus").alias("value"))
    return tables.title_block(rows, F.broadcast(spark.createDataFrame(list(TAGS.items()), "tag string, label string")), "o_custkey", ["o_orderkey"])


@query("SELECT n_name AS layer, string_agg(s_name, ',' ORDER BY s_acctbal DESC, s_suppkey) AS texts FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def layer_texts(spark, d):
    rows = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    texts = rows.select(F.col("n_name").alias("layer"), F.col("s_suppkey").alias("x"), F.col("s_acctbal").alias("y"), F.col("s_name").alias("text"))
    return tables.text_by_layer(texts).select("layer", F.array_join("texts", ",").alias("texts"))


@query(
    """SELECT *, CASE WHEN failed = total THEN 'Failed' WHEN failed + part > 0 THEN 'Medium' ELSE 'High' END AS overall FROM (
  SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS done, count(*) FILTER (o_orderstatus = 'P') AS part, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY o_custkey)"""
)
def chunk_outcomes(spark, d):
    code = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", -1).otherwise(9)
    return tables.chunk_outcome(_t(spark, d, "orders").select("o_custkey", code.alias("code")), "o_custkey")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS completed, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders")
def batch_totals(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "P", "skipped").when(F.col("o_orderstatus") == "F", "failed: no reader")
    return tables.batch_totals(_t(spark, d, "orders").select(s.alias("status")))


@query(
    """SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS elapsed,
  CASE WHEN s > 10 THEN CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS remaining
FROM (SELECT o_orderkey, trunc(o_totalprice / 50)::BIGINT AS s FROM orders)"""
)
def elapsed_labels(spark, d):
    s = (F.col("o_totalprice") / 50).cast("long")
    return _t(spark, d, "orders").select("o_orderkey", tables.elapsed(s).alias("elapsed"), tables.remaining(s, F.lit(0.5)).alias("remaining"))


@query(
    r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(b, '(.)\.[^.]*$', '\1'), '[<>:"/\\|?*]', '_', 'g')), ''), 'output') AS stem, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS extension,
  CASE WHEN e = 'jpeg' THEN 'jpg' WHEN e <> '' THEN e ELSE 'gif' END AS media FROM (SELECT page_id, url, regexp_extract(url, '([^/\\]*)$', 1) AS b, regexp_extract(url, '[^/.][^/]*\.([^./]+)$', 1) AS e FROM pages)"""
)
def file_names(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", T.safe_stem(u).alias("stem"), T.extension(u).alias("extension"), tables.media_extension(u, F.lit("image/gif")).alias("media"))


@query(
    """SELECT conv_id, count(*) AS lines, count(*) FILTER (lower(text) <> lower(p) AND trim(p) <> '') AS translated FROM (
  SELECT conv_id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id"""
)
def translated_lines(spark, d):
    rows = _t(spark, d, "conversations").withColumn("p", F.expr("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("lines"), F.count(tables.changed_translation(F.col("text"), F.col("p"))).alias("translated"))


@query(
    """SELECT conv_id, n, pages, CASE WHEN n::DOUBLE / pages >= 0.9 THEN 'High' WHEN n::DOUBLE / pages >= 0.6 THEN 'Medium' WHEN n > 0 THEN 'Low' ELSE 'Failed' END AS label FROM (
  SELECT conv_id, count(*) FILTER (length(text) >= 100) AS n, count(*) AS pages FROM conversations GROUP BY conv_id)"""
)
def extraction_labels(spark, d):
    g = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.length("text") >= 100).alias("n"), F.count(F.lit(1)).alias("pages"))
    return g.withColumn("label", confidence.extraction_label(F.col("n"), F.col("pages")))


@query(
    """SELECT doc_id, ragged, lines, CASE WHEN ragged::DOUBLE / lines > 0.2 THEN 'Low' WHEN ragged > 0 THEN 'Medium' ELSE 'High' END AS label FROM (
  SELECT doc_id, len(ws) AS lines, len(list_filter(ws, lambda w: w <> ws[1])) AS ragged FROM (SELECT doc_id, list_transform(string_split(text, e'\\n'), lambda x: len(string_split(x, ','))) AS ws FROM documents))"""
)
def ragged_labels(spark, d):
    widths = F.transform(F.split("text", "\n", -1), lambda x: F.size(F.split(x, ",", -1)))
    rows = _t(spark, d, "documents").select("doc_id", widths.alias("ws"))
    rows = rows.select("doc_id", F.size(F.filter("ws", lambda w: w != F.col("ws")[0])).cast("long").alias("ragged"), F.size("ws").cast("long").alias("lines"))
    return rows.withColumn("label", confidence.ragged_label(F.col("ragged"), F.col("lines")))


@query(
    """SELECT doc_id, page_no, string_agg('<span class=''ocrx_word'' title=''bbox ' || x || ' ' || no * 20 || ' ' || x + 25 || ' ' || no * 20 + 12 || '; x_wconf ' || CASE WHEN k < 3 AND k > 0 THEN 50 ELSE 25 END || '''>' || f || '</span>', e'\\n' ORDER BY no) AS hocr FROM (
  SELECT l_orderkey AS doc_id, 1 AS page_no, l_partkey % 4 * 30 AS x, l_returnflag AS f, l_partkey % 5 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS no FROM lineitem)
WHERE k NOT IN (3, 4) GROUP BY doc_id, page_no"""
)
def hocr_pages(spark, d):
    """Words whose confidence is fine, over one, not a number, or below zero, and blank ones."""
    b, k = _boxes(spark, d), F.col("l_partkey") % 5
    conf = F.when(k == 1, 7.0).when(k == 2, F.lit(float("nan"))).when(k == 3, -1.0).otherwise(0.25)
    words = b.select("doc_id", "page_no", F.col("no").alias("word_id"), F.when(k == 4, " ").otherwise(F.col("l_returnflag")).alias("text"), conf.alias("conf"), F.col("x0").alias("l"), F.col("y0").alias("t"), F.col("x1").alias("r"), F.col("y1").alias("b"))
    return layout.hocr(tables.usable_words(words), 10_000, 100_000)


@query("SELECT event_id, least(event_id % 7, 3, event_id % 5)::DOUBLE AS l, 2.0::DOUBLE AS t, greatest(event_id % 7, 3, event_id % 5)::DOUBLE AS r, (2 + event_id % 3)::DOUBLE AS b FROM events")
def polygon_boxes(spark, d):
    e = F.col("event_id")
    points = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((e % 7, F.lit(2)), (F.lit(3), e % 3 + 2), (e % 5, F.lit(2)))])
    return _t(spark, d, "events").select("event_id", layout.bbox(points).alias("x")).select("event_id", "x.*")


@query("SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS page_no, md5(text) AS md5 FROM conversations WHERE NOT contains(text, chr(12))")
def sidecar_pages(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    docs = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(parts, "\f").alias("text"))
    return files.sidecar_pages(docs).select("doc_id", "page_no", F.md5("text").alias("md5"))


@query(
    """SELECT doc_id AS file, e'Overall: ' || CASE WHEN quality = 0 THEN 'Low' WHEN toxic = 1 THEN 'Medium' ELSE 'High' END || e'\\nText extraction: ' || CASE quality WHEN 1 THEN 'High' ELSE 'Low' END
  || e'\\nTable structure: ' || CASE toxic WHEN 1 THEN 'Medium' ELSE 'N/A' END || e'\\nImage extraction: N/A\\nImage placement: N/A\\nDocument order: High\\nManual review recommended: ' || CASE toxic WHEN 1 THEN 'Yes' ELSE 'No' END AS report FROM labels"""
)
def confidence_reports(spark, d):
    label = {d_: F.lit("N/A") for d_ in confidence.DIMENSIONS} | {
        "text_extraction": F.when(F.col("quality") == 1, "High").otherwise("Low"),
        "table_structure": F.when(F.col("toxic") == 1, "Medium").otherwise("N/A"),
        "document_order": F.lit("High"),
    }
    rows = _t(spark, d, "labels").select(F.col("doc_id").alias("file"), *[c.alias(k) for k, c in label.items()], (F.col("toxic") == 1).alias("manual_review_recommended"))
    return confidence.report(rows)

"""Queries over the driver's tables, and their SQL where SQL can express them.

Documents of one source stand for the pages of one document; turns of a
conversation for pages; rows of a table for a sheet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import chunking, confidence, layout, postprocess, rules, tables, validation
from leafmill.plans import builders, extras, flows, structure
from leafmill.sources import html

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


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as pages with a running head and foot."""
    text = F.concat(F.lit("Report "), "source", F.lit("\n"), "text", F.lit("\nConfidential"))
    return _t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), text.alias("text"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


def _md(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown with headings, a link, an image, a table and a page mark."""
    text = F.concat(
        F.lit('# Title\n\n<a id="page-1"></a>\n\n[top](#page-1) ![fig](a.png)\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n### Deep\n\n'), "text", F.lit("\n\n[gone](#page-9)\n")
    )
    return _t(spark, d, "documents").select("doc_id", "lang", text.alias("text"))


MD_SQL = """(SELECT doc_id, lang, '# Title\n\n<a id="page-1"></a>\n\n[top](#page-1) ![fig](a.png)\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n### Deep\n\n' || text || '\n\n[gone](#page-9)\n' AS text FROM documents)"""
PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)```.*?```', '', 'g'), '\A---\n(?s:.*?)\n---', ''), '[#*|`\[\]()>_~]', ' ', 'g'), '<[^>]+>', '', 'g')"
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
SYL = r"""CASE WHEN length({0}) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all({0}, '[aeiouy]+')) - (CASE WHEN suffix({0}, 'e') AND NOT suffix({0}, 'le') THEN 1 ELSE 0 END) - (CASE WHEN suffix({0}, 'ed') THEN 1 ELSE 0 END)) END"""
BARE = r"""regexp_replace(lower(w), '^[.,;:!?"''()\-]+|[.,;:!?"''()\-]+$', '', 'g')"""
COUNTS_SQL = rf"""
SELECT doc_id, lang, len(regexp_extract_all(text, '(?m)^(#{{1,6}})\s+\S'))::INTEGER AS heading_count,
  len(regexp_extract_all(text, '(?m)^\|[\s:]*-+[\s:]*\|'))::INTEGER AS table_count,
  len(regexp_extract_all(text, '!\[([^\]]*)\]\(([^)]+)\)'))::INTEGER AS image_count,
  len(regexp_extract_all(text, '(?i)<a\s+id="page-(\d+)"'))::INTEGER AS page_count,
  (len(regexp_extract_all(text, '\[([^\]]+)\]\(([^)]+)\)')) - len(regexp_extract_all(text, '!\[([^\]]+)\]\(([^)]+)\)')))::INTEGER AS link_count,
  len({WORDS.format(PLAIN.format("text"))})::INTEGER AS word_count
FROM {{0}}"""
GRADE_SQL = rf"""
SELECT doc_id, lang, n AS n_words, s AS n_sentences, y AS n_syllables,
  greatest(0.0, least(30.0, round(0.39 * (n::DOUBLE / s) + 11.8 * (y::DOUBLE / n) - 15.59, 1)))::DOUBLE AS grade
FROM (SELECT doc_id, lang, greatest(len(ws), 1)::INTEGER AS n,
    greatest(len(list_filter(regexp_split_to_array(p, '[.!?]+'), lambda s: trim(s, e' \n\t\r') <> '')), 1)::INTEGER AS s,
    coalesce(list_sum(list_transform(list_transform(ws, lambda w: {BARE}), lambda v: {SYL.format("v")})), 0)::INTEGER AS y
  FROM (SELECT doc_id, lang, p, {WORDS.format("regexp_replace(p, '[.!?]+', ' ', 'g')")} AS ws FROM (SELECT doc_id, lang, {PLAIN.format("text")} AS p FROM {{0}})))"""
LABEL_SQL = "CASE WHEN {0} <= 5 THEN 'Very Easy (Grade 5)' WHEN {0} <= 8 THEN 'Easy (Grade ' || ceil({0})::INTEGER || ')' WHEN {0} <= 12 THEN 'Standard (Grade ' || ceil({0})::INTEGER || ')' WHEN {0} <= 16 THEN 'College Level' ELSE 'Graduate Level' END"


@query(COUNTS_SQL.replace("{0}", MD_SQL))
def doc_validation_counts(spark, d):
    return validation.counts(_md(spark, d)).drop("text")


@query(f"SELECT *, {LABEL_SQL.format('grade')} AS grade_label FROM ({GRADE_SQL.replace('{0}', 'documents')})")
def doc_readability(spark, d):
    return validation.grades(_t(spark, d, "documents").select("doc_id", "lang", "text")).drop("text")


@query(
    f"""SELECT lang, documents, heading_count, table_count, image_count, page_count, link_count, word_count, round(m, 1) AS avg_grade, {LABEL_SQL.format("m")} AS label FROM (
  SELECT c.lang, count(*) AS documents, sum(heading_count)::BIGINT AS heading_count, sum(table_count)::BIGINT AS table_count, sum(image_count)::BIGINT AS image_count,
    sum(page_count)::BIGINT AS page_count, sum(link_count)::BIGINT AS link_count, sum(word_count)::BIGINT AS word_count, coalesce(avg(CASE WHEN grade > 0 THEN grade END), 0) AS m
  FROM ({COUNTS_SQL.replace("{0}", MD_SQL)}) c JOIN ({GRADE_SQL.replace("{0}", MD_SQL)}) g USING (doc_id) GROUP BY c.lang)"""
)
def doc_validation_by_lang(spark, d):
    return validation.roll_up(validation.validated(_md(spark, d)), "lang")


JUMPS_SQL = r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, e'\n') AS ls FROM documents)),
h AS (SELECT doc_id, pos, length(line) % 5 + 1 AS level FROM l WHERE regexp_matches(line, '^[a-zA-Z]') AND length(line) % 7 < 3),
j AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM h)
SELECT doc_id, pos::INTEGER AS pos, 'H' || last || ' jumps to H' || level || ' (skipped H' || (last + 1) || ')' AS issue FROM j WHERE level > last + 1"""


def _headed(spark, d) -> DataFrame:
    """Documents in which lines of some lengths are headings, of a level by their length."""
    line = lambda x: F.when(x.rlike("^[a-zA-Z]") & (F.length(x) % 7 < 3), F.concat(F.repeat(F.lit("#"), F.length(x) % 5 + 1), F.lit(" "), x)).otherwise(F.regexp_replace(x, "^[#`-]+", ""))
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


@query(JUMPS_SQL)
def heading_jumps(spark, d):
    return validation.heading_jumps(_headed(spark, d))


@query(
    "WITH i AS (" + JUMPS_SQL + """), g AS (SELECT doc_id, list(issue ORDER BY pos) AS issues FROM i GROUP BY doc_id)
SELECT source, sum(len(issues))::BIGINT AS n, md5(string_agg(array_to_string(issues, ';'), ';' ORDER BY doc_id)) AS md5 FROM g JOIN documents USING (doc_id) GROUP BY source"""
)
def issues_by_source(spark, d):
    found = validation.issues(_headed(spark, d)).join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return validation.all_issues(found, "doc_id", "source").select("source", F.size("issues").cast("long").alias("n"), F.md5(F.array_join("issues", ";")).alias("md5"))


@query(
    """WITH t AS (SELECT doc_id, unnest(['page-' || (doc_id % 4), 'top', 'part-' || (doc_id % 3), 'one-two']) AS anchor, unnest(['a', 'b', 'c', 'd']) AS label FROM documents)
SELECT doc_id, label, anchor FROM t WHERE anchor NOT IN ('page-1', 'page-2', 'part-1', 'one-two')"""
)
def broken_links(spark, d):
    links = F.format_string("[a](#page-%d) [b](#top) [c](#part-%d) [d](#one-two)\n", F.col("doc_id") % 4, F.col("doc_id") % 3)
    marks = F.lit('<a id="page-1"></a> <A ID="page-2"></a>\n\n# Part 1\n\n## One, two!\n\n```\n# Top\n```\n')
    return validation.broken_links(_t(spark, d, "documents").select("doc_id", F.concat(links, marks, F.regexp_replace("text", "[\\[#`]", "")).alias("text")))


@query(r"SELECT conv_id AS doc_id, turn AS page_no FROM conversations WHERE length(regexp_replace(text, '\s', '', 'g')) >= 60")
def blank_page_filter(spark, d):
    return postprocess.drop_blank_pages(_turns(spark, d), 60).select("doc_id", "page_no")


EDGES_SQL = r"""
WITH l AS (SELECT source AS doc_id, doc_id AS page_no, list_transform(regexp_split_to_array('Report ' || source || e'\n' || text || e'\nConfidential', '\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS ls FROM documents),
e AS (SELECT DISTINCT * FROM (SELECT doc_id, page_no, 'head' AS side, unnest(ls[1:3]) AS norm FROM l UNION ALL SELECT doc_id, page_no, 'foot', unnest(CASE WHEN len(ls) > 3 THEN ls[-3:] ELSE ls[-1:] END) FROM l) WHERE norm <> ''),
n AS (SELECT doc_id, count(*) AS pages FROM l GROUP BY doc_id)
SELECT e.doc_id, side, norm, count(*) AS n FROM e JOIN n USING (doc_id) GROUP BY e.doc_id, side, norm, pages HAVING count(*) >= greatest(3, pages // 2)"""


@query(EDGES_SQL)
def header_footer_candidates(spark, d):
    return postprocess.repeated_edges(_pages(spark, d))


@query("SELECT source AS doc_id, doc_id AS page_no, md5(regexp_replace(text, '\\n$', '')) AS md5 FROM documents")
def header_footer_removed(spark, d):
    return postprocess.remove_repeated_edges(_pages(spark, d)).select("doc_id", "page_no", F.md5("text").alias("md5"))


@query("SELECT doc_id, 1 AS page_no, md5(text) AS md5 FROM documents WHERE len(string_split(text, e'\\n')) >= 5")
def line_numbers_stripped(spark, d):
    lines = F.split("text", "\n", -1)
    marked = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x)), "\n")
    pages = _t(spark, d, "documents").where(F.size(lines) >= 5).select("doc_id", F.lit(1).alias("page_no"), marked.alias("text"))
    return postprocess.strip_line_numbers(pages).select("doc_id", "page_no", F.md5("text").alias("md5"))


@query(
    r"""SELECT doc_id, (count(*) FILTER (code))::BIGINT AS code_lines, count(*) AS lines FROM (
  SELECT doc_id, (s <> '' AND (regexp_matches(s, '(?m)(?:import\s+[\w.]+|from\s+[\w.]+\s+import|def\s+\w+\s*\(|class\s+\w+[\s:(]|function\s+\w+\s*\(|const\s+\w+\s*=|var\s+\w+\s*=|let\s+\w+\s*=|#include\s*[<"]|public\s+(?:static|class|void|int|String)|if\s*\(.+\)\s*\{|for\s*\(.+\)\s*\{|while\s*\(.+\)\s*\{|return\s+.+;|^\s*[{}];?\s*$)')
    OR (length(s) > 5 AND length(regexp_replace(s, '[^{}();\[\]<>=!&|^~@#$]', '', 'g'))::DOUBLE / length(s) > 0.15))) AS code
  FROM (SELECT doc_id, trim(unnest(string_split(text, e'\n'))) AS s FROM documents)) GROUP BY doc_id"""
)
def code_lines(spark, d):
    lines = T.explode_lines(_t(spark, d, "documents").select("doc_id", "text"), ["doc_id"], newline_only=True)
    return lines.groupBy("doc_id").agg(F.count_if(postprocess.is_code_line(F.col("line"))).alias("code_lines"), F.count(F.lit(1)).alias("lines"))


_CODE_SQL = r"(?m)(?:import\s+[\w.]+|from\s+[\w.]+\s+import|def\s+\w+\s*\(|class\s+\w+[\s:(]|function\s+\w+\s*\(|const\s+\w+\s*=|var\s+\w+\s*=|let\s+\w+\s*=|#include\s*[<\"]|public\s+(?:static|class|void|int|String)|if\s*\(.+\)\s*\{|for\s*\(.+\)\s*\{|while\s*\(.+\)\s*\{|return\s+.+;|^\s*[{}];?\s*$)"
_LANGUAGE_SQL = " ".join(f"WHEN regexp_matches(x, '{pattern}') THEN '{name}'" for name, pattern in postprocess.LANGUAGES)


@query(
    r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text || e'\n\ndef f(x):\n    y = x + 1\n    return y;\n\nEnd.', e'\n') AS ls FROM documents)),
t AS (SELECT *, regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM l),
f AS (SELECT *, starts_with(t, '```') AS fence, sum(starts_with(t, '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS open FROM t),
k AS (SELECT *, CASE WHEN fence OR open THEN 't' WHEN t = '' THEN 'b' WHEN starts_with(line, '    ') OR starts_with(line, e'\t') OR regexp_matches(t, '@code') OR (length(t) > 5 AND length(regexp_replace(t, '[^{}();\[\]<>=!&|^~@#$]', '', 'g'))::DOUBLE / length(t) > 0.15) THEN 'c' ELSE 't' END AS k FROM f),
i AS (SELECT *, k = 'c' OR (k = 'b' AND coalesce(last_value(CASE WHEN k <> 'b' THEN k = 'c' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), false)) AS inside FROM k),
e AS (SELECT *, coalesce(inside <> lag(inside) OVER (PARTITION BY doc_id ORDER BY pos), true) AS edge FROM i),
r AS (SELECT *, sum(edge::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM e),
g AS (SELECT *, max(pos) FILTER (k = 'c') OVER (PARTITION BY doc_id, run) AS last FROM r),
p AS (SELECT doc_id, run, count(*) FILTER (k = 'c' AND inside) >= 3 AS fenced, string_agg(line, e'\n' ORDER BY pos) AS x FROM g WHERE NOT inside OR pos <= last GROUP BY doc_id, run),
d AS (SELECT doc_id, string_agg(CASE WHEN fenced THEN '```' || CASE @languages ELSE '' END || e'\n' || x || e'\n```' ELSE x END, e'\n' ORDER BY run) AS text FROM p GROUP BY doc_id)
SELECT doc_id, len(regexp_extract_all(text, '(?m)^```'))::INTEGER AS fences, md5(text) AS md5 FROM d""".replace("@code", _CODE_SQL).replace("@languages", _LANGUAGE_SQL)
)
def code_blocks(spark, d):
    text = F.concat("text", F.lit("\n\ndef f(x):\n    y = x + 1\n    return y;\n\nEnd."))
    pages = _t(spark, d, "documents").select("doc_id", F.lit(1).alias("page_no"), text.alias("text"))
    return postprocess.code_blocks(pages).select("doc_id", F.regexp_count("text", F.lit("(?m)^```")).alias("fences"), F.md5("text").alias("md5"))


GREEK_SQL = f"[{postprocess.GREEK}]"
EXPR_SQL = rf"({GREEK_SQL}(?:\s*[=<>+\-*/^_]\s*[a-zA-Z0-9{postprocess.GREEK}]*)*)"


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text || e'\nx = α + β\nthe angle θ is small', e'\n') AS ls FROM documents)),
t AS (SELECT *, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM l),
f AS (SELECT *, replace(t, ' ', '') AS dense, starts_with(t, '```') OR sum(starts_with(t, '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS code FROM t),
m AS (SELECT *, length(t) >= 3 AND regexp_matches(t, '[=<>≠≈≤≥+\-*/^]') AND length(dense) BETWEEN 1 AND 119 AND (regexp_matches(t, '{GREEK_SQL}') OR regexp_matches(t, '\\[a-zA-Z]+')
  OR length(regexp_replace(t, '[^{postprocess.MATH}{postprocess.GREEK}]', '', 'g'))::DOUBLE / length(dense) > 0.1
  OR (regexp_matches(t, '^[A-Za-z_][\p{{L}}\p{{N}}_]*\s*=\s*.*[+\-*/^]') AND NOT regexp_matches(t, '[a-z]{{4,}}\('))) AS math FROM f)
SELECT doc_id, md5(string_agg(CASE WHEN code OR contains(line, '$') THEN line WHEN math THEN '$$' || t || '$$'
  WHEN len(list_filter(regexp_extract_all(line, '{EXPR_SQL}'), lambda x: length(x) > 40)) > 0 THEN line ELSE regexp_replace(line, '{EXPR_SQL}', '$\1$', 'g') END, e'\n' ORDER BY pos)) AS md5 FROM m GROUP BY doc_id"""
)
def equations(spark, d):
    text = F.concat("text", F.lit("\nx = α + β\nthe angle θ is small"))
    return _t(spark, d, "documents").select("doc_id", F.md5(postprocess.equations(text)).alias("md5"))


MARK_SQL = r"""([a-zA-Z.,;:!?"'')])0{0,2}([12])([\s.,;:!?)]|$)"""


@query(
    rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\n\t ]+$', '') || ' see note1 and note2.', '{MARK_SQL}', '\1[^\2]\3', 'g'), '{MARK_SQL}', '\1[^\2]\3', 'g')
  || e'\n\n[^1]: First.\n[^2]: Second.') AS md5 FROM documents"""
)
def footnotes(spark, d):
    text = F.concat(F.regexp_replace("text", "[\\n\\t ]+\\z", ""), F.lit(" see note1 and note2.\n\n## Notes\n1. First.\n2. Second.\n"))
    return _t(spark, d, "documents").select("doc_id", F.md5(postprocess.footnotes(text)).alias("md5"))


@query()
def cleaned_pages(spark, d):
    return postprocess.run_pipeline(_pages(spark, d)).select("doc_id", "page_no", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


def _broken_pages(spark, d) -> DataFrame:
    """Documents as pages of 40 words, in two lines each, so that most pages end within a sentence."""
    ws = F.filter(F.split("text", "\\s+"), lambda x: x != "")
    rows = _t(spark, d, "documents").select("doc_id", ws.alias("ws")).where(F.size("ws") > 0)
    pages = rows.select("doc_id", "ws", F.explode(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 40).cast("int"))).alias("page_no"))
    line = lambda start: F.array_join(F.slice("ws", F.col("page_no") * 40 + start, F.lit(20)), " ")
    return pages.select("doc_id", "page_no", F.concat_ws("\n", line(1), F.nullif(line(21), F.lit(""))).alias("text"))


PAGES_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, (len(ws) - 1) // 40 + 1))::INTEGER AS page_no FROM w WHERE len(ws) > 0),
l AS (SELECT doc_id, page_no, array_to_string(ws[page_no * 40 + 1:page_no * 40 + 20], ' ') AS a, nullif(array_to_string(ws[page_no * 40 + 21:page_no * 40 + 40], ' '), '') AS b FROM p),
n AS (SELECT *, coalesce(b, a) AS tail, lead(a) OVER (PARTITION BY doc_id ORDER BY page_no) AS head FROM l),
g AS (SELECT *, coalesce(NOT regexp_matches(tail, '[.!?:]$|^(#|[-*] |\d+[.]\s)') AND regexp_matches(head, '^\p{Ll}'), false) AS gives FROM n)"""


@query(PAGES_SQL + "SELECT doc_id, page_no, tail, head FROM g WHERE gives")
def cross_page_merge_candidates(spark, d):
    return postprocess.merge_candidates(_broken_pages(spark, d))


@query(
    PAGES_SQL
    + """, m AS (SELECT *, lag(CASE WHEN gives THEN tail END) OVER (PARTITION BY doc_id ORDER BY page_no) AS got FROM g)
SELECT doc_id, page_no, md5(concat_ws(e'\\n', CASE WHEN b IS NULL AND gives THEN NULL ELSE concat_ws(' ', got, a) END, CASE WHEN NOT gives THEN b END)) AS md5 FROM m"""
)
def cross_page_merged(spark, d):
    return postprocess.merge_across_pages(_broken_pages(spark, d)).select("doc_id", "page_no", F.md5("text").alias("md5"))


CHUNK_SQL = r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, unnest(CASE WHEN len(ws) <= 512 THEN [text] ELSE [array_to_string(ws[i+1:i+512], ' ') for i in range(0, len(ws), 462)] END) AS chunk,
  unnest(CASE WHEN len(ws) <= 512 THEN [0] ELSE [i // 462 for i in range(0, len(ws), 462)] END) AS chunk_index FROM w WHERE len(ws) > 0)"""


@query(
    CHUNK_SQL
    + "SELECT doc_id, chunk_index::INTEGER AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, 'doc' || doc_id || '_chunk_' || lpad(chunk_index::VARCHAR, 4, '0') AS id, md5(chunk) AS md5 FROM c"
)
def sidecar_chunks(spark, d):
    parts = chunking.stride_chunks(_t(spark, d, "documents").select("doc_id", "text"), ["doc_id"])
    out = chunking.numbered(parts, "doc_id", ["k"], F.concat(F.lit("doc"), "doc_id"))
    return out.select("doc_id", "chunk_index", "total_chunks", "id", F.md5("chunk").alias("md5"))


@query(CHUNK_SQL + r"SELECT lang, count(*) AS chunks, max(len(string_split(chunk, ' ')))::INTEGER AS longest FROM c JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "text")
    parts = chunking.stride_chunks(docs, ["doc_id", "lang"])
    return parts.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.size(F.split("chunk", " "))).alias("longest"))


def _whole(spark, d) -> DataFrame:
    """Documents as one section each, their lines as paragraphs."""
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return _t(spark, d, "documents").select("doc_id", F.lit(0).alias("sec_no"), F.lit("## Whole").alias("heading"), body.alias("body"), F.lit(1).alias("page_number"))


def _sections(spark, d) -> DataFrame:
    """Lines of documents as sections, every third with a heading, two to a page."""
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("sec_no", "body"))
    heading = F.when(F.col("sec_no") % 3 == 0, F.concat(F.lit("## Part "), "sec_no")).otherwise("")
    return lines.select("doc_id", "sec_no", heading.alias("heading"), "body", (F.floor(F.col("sec_no") / 2) + 1).cast("int").alias("page_number"))


def _outputs(spark, d, sections: DataFrame) -> DataFrame:
    """Documents with their sections, a confidence for two of three, contents, pictures and a warning."""
    n = F.col("doc_id") % 3
    label = F.when(n == 0, "High").otherwise("Medium")
    confidence_ = F.when(
        n < 2, F.struct(label.alias("overall"), *[label.alias(x) for x in confidence.DIMENSIONS], (n == 1).alias("manual_review_recommended"), F.array().cast("array<string>").alias("notes"), F.array(F.lit("w")).alias("warnings"))
    )
    toc = F.array(F.struct(F.lit(1).alias("level"), F.lit("Part 0").alias("title"), F.lit(1).alias("page")), F.struct(F.lit(2).alias("level"), F.lit("More").alias("title"), F.lit(None).cast("int").alias("page")))
    docs = _t(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("in/"), "source", F.lit("/doc"), "doc_id", F.lit(".pdf")).alias("source_file"), F.lit("spark").alias("engine"), confidence_.alias("confidence"), toc.alias("toc"),
        F.array(F.lit("assets/a.png")).alias("assets"), F.array(F.lit("slow")).alias("warnings"),
    )
    return builders.assemble(sections, docs)


PACK_SQL = r"""
WITH RECURSIVE s AS (SELECT doc_id, regexp_replace(replace(text, e'\n', e'\n\n'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS body FROM documents),
w AS (SELECT doc_id, body, list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '') AS ws,
  list_filter(list_transform(regexp_split_to_array(body, '\n\n+'), lambda p: list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')), lambda p: len(p) > 0) AS ps FROM s),
f(doc_id, i, done, now) AS (
  SELECT doc_id, 0, []::VARCHAR[], []::VARCHAR[] FROM w WHERE len(ws) > 512
  UNION ALL
  SELECT doc_id, i + 1,
    list_concat(CASE WHEN len(now) > 0 AND len(now) + len(p) > 512 THEN list_append(done, array_to_string(now, ' ')) ELSE done END,
      CASE WHEN len(p) > 512 THEN [array_to_string(list_concat(CASE WHEN k = 0 THEN now[-50:] ELSE p[k - 49:k] END, p[k + 1:k + 512]), ' ') for k in range(0, len(p), 512)] ELSE []::VARCHAR[] END),
    CASE WHEN len(p) > 512 THEN p[-50:] WHEN len(now) > 0 AND len(now) + len(p) > 512 THEN list_concat(now[-50:], p) ELSE list_concat(now, p) END
  FROM (SELECT f.*, ps[i + 1] AS p FROM f JOIN w USING (doc_id) WHERE i < len(ps))),
parts AS (SELECT doc_id, CASE WHEN len(now) > 0 THEN list_append(done, array_to_string(now, ' ')) ELSE done END AS cs FROM f JOIN w USING (doc_id) WHERE i = len(ps)
  UNION ALL SELECT doc_id, [body] FROM w WHERE len(ws) BETWEEN 1 AND 512),
c AS (SELECT doc_id, unnest(cs) AS chunk, unnest(range(len(cs)))::INTEGER AS k, len(cs) AS total FROM parts)
"""


@query(PACK_SQL + r"SELECT doc_id, 0 AS sec_no, k, len(list_filter(regexp_split_to_array(chunk, '\s+'), lambda x: x <> ''))::INTEGER AS n_words, md5(chunk) AS md5 FROM c")
def section_chunks(spark, d):
    return chunking.section_chunks(_whole(spark, d)).select("doc_id", "sec_no", "k", F.size(F.split("chunk", "\\s+")).alias("n_words"), F.md5("chunk").alias("md5"))


@query(
    PACK_SQL
    + """SELECT doc_id, k AS chunk_index, 'doc' || doc_id || '_chunk_' || lpad(k::VARCHAR, 4, '0') AS id, md5(chunk) AS md5, 'doc' || doc_id || '.pdf' AS source, total::INTEGER AS total, 1 AS page,
  'Whole' AS heading, CASE doc_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' END AS confidence FROM c"""
)
def chunk_records(spark, d):
    """Records as JSON lines, read back."""
    schema = "id string, text string, metadata struct<source:string, chunk_index:int, total_chunks:int, page:int, heading:string, confidence:string>"
    r = builders.chunk_records(_outputs(spark, d, _whole(spark, d))).select("doc_id", "chunk_index", F.from_json("json", schema).alias("r"))
    return r.select("doc_id", "chunk_index", "r.id", F.md5("r.text").alias("md5"), "r.metadata.source", F.col("r.metadata.total_chunks").alias("total"), "r.metadata.page", "r.metadata.heading", "r.metadata.confidence")


LINES_SQL = r"""l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc_id, string_split(text, e'\n') AS ls FROM documents)),
s AS (SELECT *, regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS body, CASE WHEN n % 3 = 0 THEN 'Part ' || n END AS title, CASE WHEN n % 2 = 0 THEN n // 2 + 1 END AS page FROM l),
d AS (SELECT doc_id, 'doc' || doc_id AS name, CASE doc_id % 3 WHEN 0 THEN 'Conversion confidence: High.' WHEN 1 THEN 'Conversion confidence: Medium. Manual review recommended.' END AS note FROM documents)"""
TRIM_SQL = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(
    "WITH "
    + LINES_SQL
    + r""", p AS (SELECT doc_id, n, concat_ws(e'\n', '<a id="page-' || page || e'"></a>\n\n---\n*Page ' || page || '*', '## ' || title, CASE WHEN line <> '' THEN body END, '') AS x FROM s)
SELECT doc_id, md5("""
    + TRIM_SQL.format(r"concat_ws(e'\n', '> ' || any_value(note) || e'\n', e'## Table of Contents\n\n- [Part 0](#page-1)\n  - [More](#)\n\n---\n', string_agg(x, e'\n' ORDER BY n))")
    + r" || e'\n') AS md5 FROM p JOIN d USING (doc_id) GROUP BY doc_id"
)
def markdown_documents(spark, d):
    return builders.render(_outputs(spark, d, _sections(spark, d)), "Markdown").select("doc_id", F.md5("text").alias("md5"))


@query(
    "WITH "
    + LINES_SQL
    + """SELECT doc_id, any_value(name) || '.pdf' AS source_file, 'spark' AS engine, CASE doc_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' END AS overall, CASE doc_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS review,
  2 AS entries, count(*)::INTEGER AS n, md5(string_agg(concat_ws('|', n // 2 + 1, title, CASE WHEN line <> '' THEN body END), e'\\n' ORDER BY n)) AS md5, 'a.png' AS asset, 'slow' AS warning
FROM s JOIN d USING (doc_id) GROUP BY doc_id"""
)
def json_documents(spark, d):
    """Documents as JSON, read back."""
    section = "struct<heading:string, body:string, page:int>"
    schema = f"document struct<source_file:string, engine:string>, confidence struct<overall:string, manual_review_recommended:boolean>, table_of_contents array<struct<title:string>>, sections array<{section}>, assets array<string>, warnings array<string>"
    j = builders.render(_outputs(spark, d, _sections(spark, d)), "JSON").select("doc_id", F.from_json("text", schema).alias("j"))
    row = F.transform("j.sections", lambda x: F.concat_ws("|", x["page"].cast("string"), x["heading"], x["body"]))
    return j.select(
        "doc_id", "j.document.source_file", "j.document.engine", "j.confidence.overall", F.col("j.confidence.manual_review_recommended").alias("review"), F.size("j.table_of_contents").alias("entries"),
        F.size("j.sections").alias("n"), F.md5(F.array_join(row, "\n")).alias("md5"), F.col("j.assets")[0].alias("asset"), F.col("j.warnings")[0].alias("warning"),
    )


def _escaped_sql(x: str) -> str:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{sign}', '{entity}')"
    return x


def _spans_sql(x: str) -> str:
    for pattern, new in (
        (r"!\[([^\]]*)\]\(([^)]+)\)", r'<img src="\2" alt="\1">'), (r"\[([^\]]+)\]\(([^)]+)\)", r'<a href="\2">\1</a>'), (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"\*(.+?)\*", r"<em>\1</em>"), ("`(.+?)`", r"<code>\1</code>"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


CELLS_SQL = r"list_transform(string_split(regexp_replace(body, '^\||\|$', '', 'g'), '|'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"


@query(
    "WITH "
    + LINES_SQL
    + rf""", b AS (SELECT *, CASE WHEN body = '' THEN '' WHEN starts_with(body, '```') THEN '<pre><code>'
  WHEN starts_with(body, '|') THEN CASE WHEN len(list_filter({CELLS_SQL}, lambda x: NOT regexp_full_match(x, '[-: ]*'))) = 0 THEN '</table>' ELSE e'<table>\n<tr>' || array_to_string(list_transform({CELLS_SQL}, lambda x: '<th>' || {_spans_sql(_escaped_sql("x"))} || '</th>'), '') || e'</tr>\n</table>' END
  WHEN regexp_matches(body, '^#{{1,6}}\s') THEN '<h' || length(regexp_extract(body, '^(#{{1,6}})\s', 1)) || '>' || {_spans_sql(_escaped_sql("regexp_replace(body, '^#+[[:space:]]+', '')"))} || '</h' || length(regexp_extract(body, '^(#{{1,6}})\s', 1)) || '>'
  WHEN regexp_matches(body, '^-{{3,}}$') THEN '<hr>' WHEN regexp_matches(body, '^<a id="[^"]*"></a>$') THEN body ELSE '<p>' || {_spans_sql(_escaped_sql("body"))} || '</p>' END AS html FROM s),
p AS (SELECT doc_id, string_agg(concat_ws(e'\n', '<div class="page-marker" id="page-' || page || '">Page ' || page || '</div>', '<h2>' || title || '</h2>', CASE WHEN line <> '' THEN html END), e'\n' ORDER BY n)
  FILTER (page IS NOT NULL OR title IS NOT NULL OR line <> '') AS x FROM b GROUP BY doc_id)
SELECT doc_id, md5(concat_ws(e'\n', '<!DOCTYPE html>', '<html lang="en">', '<head>', '<meta charset="utf-8">', '<meta name="viewport" content="width=device-width, initial-scale=1">', '<title>' || name || '</title>',
  '<style>{builders.STYLE}</style>', '</head>', '<body>', '<h1>' || name || '</h1>', '<blockquote class="confidence">' || note || '</blockquote>', '<nav class="toc">', '<h2>Table of Contents</h2>', '<ul>',
  '  <li><a href="#page-1">Part 0</a></li>', '    <li><a href="#">More</a></li>', '</ul>', '</nav>', '<hr>', x, '</body>', '</html>', '')) AS md5 FROM p JOIN d USING (doc_id)"""
)
def html_documents(spark, d):
    return builders.render(_outputs(spark, d, _sections(spark, d)), "HTML").select("doc_id", F.md5("text").alias("md5"))


PROFILE = rules.Profile("clean", [rules.Rule("spaces", " {2,}", " "), rules.Rule("swap", r"\b(the) (\w+)", r"\2 \1"), rules.Rule("literal", "er.", "ER.", use_regex=False), rules.Rule("off", "a", "b", enabled=False), rules.Rule("bad", "(", "x")])


@query(r"SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '\b(the) (\w+)', '\2 \1', 'g'), 'er.', 'ER.')) AS md5 FROM documents")
def rules_apply(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(PROFILE.apply(F.col("text"))).alias("md5"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, ' {2,}'))::INTEGER AS spaces, len(regexp_extract_all(regexp_replace(text, ' {2,}', ' ', 'g'), '\b(the) (\w+)'))::INTEGER AS swap FROM documents"""
)
def rules_change_counts(spark, d):
    a, b, *_ = PROFILE.counts(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", a.alias("spaces"), b.alias("swap"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)the'))::INTEGER AS hits FROM documents")
def find_replace_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", rules.find_count(F.col("text"), "the").alias("hits"))


@query()
def html_markdown(spark, d):
    return html.read_html(_t(spark, d, "pages")).select("page_id", "title", F.size("toc").alias("n_toc"), "n_tables", "n_images", "markdown")


@query(r"SELECT page_id, replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')), '&amp;', '&') AS title FROM pages")
def html_titles(spark, d):
    return _t(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<script'))::INTEGER AS scripts, len(regexp_extract_all(html, '(?i)<nav'))::INTEGER AS navs,
  len(regexp_extract_all(html, '(?i)<footer'))::INTEGER AS footers FROM pages"""
)
def html_stripped_tags(spark, d):
    n = html.dropped_counts(F.col("html"))
    return _t(spark, d, "pages").select("page_id", n["script"].alias("scripts"), n["nav"].alias("navs"), n["footer"].alias("footers"))


@query(r'''SELECT page_id, u AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS u FROM pages)''')
def html_links(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))


@query("SELECT n_nationkey, '| ' || concat_ws(' | ', n_nationkey, replace(n_name, '|', '\\|'), n_regionkey) || ' |' AS line FROM nation")
def table_markdown(spark, d):
    t = _t(spark, d, "nation")
    return t.select("n_nationkey", builders.table_rows(t, ["n_nationkey", "n_name", "n_regionkey"]).alias("line"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r <= 10000")
def table_row_cap(spark, d):
    return builders.capped(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    """SELECT c_mktsegment, blank, cells, CASE WHEN blank::DOUBLE / cells > 0.5 THEN 'Low' WHEN blank::DOUBLE / cells > 0.2 THEN 'Medium' ELSE 'High' END AS label FROM (
  SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) AS blank, count(*) AS cells FROM customer GROUP BY c_mktsegment)"""
)
def table_blank_ratio(spark, d):
    g = _t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") < 0).alias("blank"), F.count(F.lit(1)).alias("cells"))
    return g.withColumn("label", confidence.blank_cell_label(F.col("blank"), F.col("cells")))


@query("SELECT n_name, coalesce(c, 0) AS entities FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def layer_counts(spark, d):
    layers = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("layer"), "n_name")
    entities = _t(spark, d, "supplier").select(F.concat(F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("layer"))
    return tables.layer_counts(layers, entities).select("n_name", "entities")


@query(
    """WITH l AS (SELECT doc_id, CASE quality WHEN 1 THEN 'High' ELSE 'Low' END AS a, CASE toxic WHEN 1 THEN 'Medium' ELSE 'N/A' END AS b FROM labels)
SELECT doc_id, a AS text_extraction, b AS table_structure, CASE WHEN a = 'Low' THEN 'Low' WHEN b = 'Medium' THEN 'Medium' ELSE 'High' END AS overall FROM l"""
)
def confidence_overall(spark, d):
    a, b = F.when(F.col("quality") == 1, "High").otherwise("Low"), F.when(F.col("toxic") == 1, "Medium").otherwise("N/A")
    return _t(spark, d, "labels").select("doc_id", a.alias("text_extraction"), b.alias("table_structure")).withColumn("overall", confidence.worst(F.col("text_extraction"), F.col("table_structure")))


@query(
    """WITH l AS (SELECT lang, doc_id, quality, toxic FROM labels JOIN documents USING (doc_id))
SELECT lang, CASE min(quality) WHEN 0 THEN 'Low' ELSE 'High' END AS text_extraction, CASE max(toxic) WHEN 1 THEN 'Medium' ELSE 'N/A' END AS ocr_confidence, bool_or(toxic = 1) AS review,
  md5(array_to_string(list('w' || doc_id ORDER BY doc_id) FILTER (toxic = 1), ';')) AS warnings FROM l GROUP BY lang"""
)
def confidence_rollup(spark, d):
    toxic = F.col("toxic") == 1
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(
        "lang", F.col("doc_id").alias("file"), F.when(F.col("quality") == 1, "High").otherwise("Low").alias("text_extraction"), F.when(toxic, "Medium").otherwise("N/A").alias("ocr_confidence"),
        toxic.alias("manual_review_recommended"), F.when(toxic, F.array(F.concat(F.lit("w"), "doc_id"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    out = confidence.aggregate(rows, "lang")
    return out.select("lang", "text_extraction", "ocr_confidence", F.col("manual_review_recommended").alias("review"), F.md5(F.array_join("warnings", ";")).alias("warnings"))


@query(
    """SELECT event_type, m AS mean, CASE WHEN m >= 0.85 THEN 'High' WHEN m >= 0.65 THEN 'Medium' WHEN m > 0 THEN 'Low' ELSE 'Failed' END AS label FROM (
  SELECT event_type, round(avg(least(1.0, greatest(0.0, value / 100))), 6) AS m FROM events GROUP BY event_type)"""
)
def ocr_label_bands(spark, d):
    m = F.round(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))), 6)
    return _t(spark, d, "events").groupBy("event_type").agg(m.alias("mean")).withColumn("label", confidence.ocr_label(F.col("mean"), F.lit(True)))


@query("SELECT level, title, min(page_id) AS page_id FROM (SELECT page_id, page_id % 2 AS level, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages) GROUP BY level, title")
def toc_dedup(spark, d):
    rows = _t(spark, d, "pages").select("page_id", (F.col("page_id") % 2).alias("level"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"))
    return layout.first_of(rows, ["level", "title"], [F.col("page_id")]).select("level", "title", "page_id")


def _unmarked_sql(text: str) -> str:
    for pattern, new in (
        (r"!\[[^\]]*\]\([^)]+\)", "[image]"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), ("__(.+?)__", r"\1"),
        ("_(.+?)_", r"\1"), ("`(.+?)`", r"\1"), (r"(?m)^#{1,6}[\s\p{Z}]+", ""), ("<[^>]+>", ""), (r"(?m)^-{3,}[\s\p{Z}]*$", "---"),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


STRIP_SQL = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split({_unmarked_sql("'**x** ' || text")}, e'\\n') AS ls FROM documents)),
c AS (SELECT *, starts_with({STRIP_SQL.format("line")}, '|') AS bar, list_transform(string_split(regexp_replace({STRIP_SQL.format("line")}, '^\\|+|\\|+$', '', 'g'), '|'), lambda x: {STRIP_SQL.format("x")}) AS cells FROM l)
SELECT doc_id, md5(string_agg(CASE WHEN bar THEN array_to_string(cells, '  |  ') ELSE line END, e'\\n' ORDER BY pos)) AS md5 FROM c
WHERE NOT bar OR len(list_filter(cells, lambda x: trim(translate(x, '-:', '')) <> '')) > 0 GROUP BY doc_id"""
)
def plaintext_strip_markdown(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.strip_markdown(F.concat(F.lit("**x** "), "text"))).alias("md5"))


@query(
    f"""WITH {LINES_SQL}, u AS (SELECT *, {_unmarked_sql("body")} AS t FROM s), c AS (SELECT *, starts_with({STRIP_SQL.format("t")}, '|') AS bar,
  list_transform(string_split(regexp_replace({STRIP_SQL.format("t")}, '^\\|+|\\|+$', '', 'g'), '|'), lambda x: {STRIP_SQL.format("x")}) AS cells FROM u),
p AS (SELECT *, CASE WHEN NOT bar THEN t WHEN len(list_filter(cells, lambda x: trim(translate(x, '-:', '')) <> '')) > 0 THEN array_to_string(cells, '  |  ') ELSE '' END AS plain FROM c),
q AS (SELECT doc_id, string_agg(concat_ws(e'\\n', '--- Page ' || page || e' ---\\n', upper(title) || e'\\n' || repeat('-', length(title)) || e'\\n', CASE WHEN line <> '' THEN plain || e'\\n' END), e'\\n' ORDER BY n)
  FILTER (page IS NOT NULL OR title IS NOT NULL OR line <> '') AS x FROM p GROUP BY doc_id)
SELECT doc_id, md5({TRIM_SQL.format("concat_ws(e'&n', upper(name), repeat('=', length(name)) || e'&n', '[' || note || ']' || e'&n', 'TABLE OF CONTENTS', repeat('-', 17), 'Part 0  (p. 1)', '  More', '', '---', '', x)").replace("&n", chr(92) + "n")} || e'\\n') AS md5 FROM q JOIN d USING (doc_id)"""
)
def plaintext_documents(spark, d):
    return builders.render(_outputs(spark, d, _sections(spark, d)), "Plain Text").select("doc_id", F.md5("text").alias("md5"))


@query(
    r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text || e'\n| a |\n![x](y)\n', e'\n')), e' \t') AS s FROM documents),
c AS (SELECT doc_id, CASE WHEN starts_with(s, '|') THEN CASE doc_id % 2 WHEN 0 THEN 'conf_low' ELSE 'conf_high' END WHEN starts_with(s, '![') THEN 'conf_medium' ELSE 'conf_high' END AS c FROM l WHERE s <> '')
SELECT doc_id, c AS class, count(*) AS n FROM c GROUP BY doc_id, c"""
)
def heatmap_classes(spark, d):
    lines = T.explode_lines(_t(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n| a |\n![x](y)\n")).alias("text")), ["doc_id"], newline_only=True)
    table = F.when(F.col("doc_id") % 2 == 0, "Failed").otherwise("N/A")
    kind = tables.line_confidence_class(F.translate("line", "\t", " "), table, F.lit("Moderate"), F.lit("High"), F.lit("High"))
    return lines.withColumn("class", kind).where("class IS NOT NULL").groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z'']{3,}')) AS w FROM benchmark))
SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z'']{3,}'))) AS w FROM documents) WHERE w NOT IN (SELECT w FROM v) GROUP BY doc_id, w"""
)
def misspelled_words(spark, d):
    known = _t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z']{3,}"), F.lit(0))).alias("word"))
    return tables.misspelled(_t(spark, d, "documents").select("doc_id", "text"), known)


@query("SELECT conv_id AS doc_id, turn AS page_no, md5(text) AS md5 FROM conversations WHERE turn IN (0, 2)")
def page_range(spark, d):
    return postprocess.page_range(_turns(spark, d), [0, 2]).select("doc_id", "page_no", F.md5("text").alias("md5"))


@query("SELECT doc_id, n::INTEGER AS sec_no, page::INTEGER AS page_number FROM (WITH " + LINES_SQL + "SELECT * FROM s) WHERE page IS NOT NULL")
def page_anchors(spark, d):
    return builders.page_anchors(_sections(spark, d).select("doc_id", "sec_no", "page_number"))


@query(
    """SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS completed, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1"""
)
def status_rollup(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "failed: x").when(F.col("o_orderstatus") == "O", "ok").otherwise("skipped")
    return tables.batch_totals(_t(spark, d, "orders").withColumn("status", s), by=["o_orderpriority"])


@query("SELECT doc_id, len(range(0, greatest(n_chars // 100, 1), 30))::BIGINT AS chunks FROM documents")
def page_plan(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 100).cast("int").alias("pages"))
    return chunking.page_plan(docs, "doc_id", "pages").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


def _words(spark, d, shift: float) -> DataFrame:
    """Words on pages from all rows of lineitem, numbered within their order: boxes on a grid, moved by ``shift``."""
    x, y = (F.col("l_partkey") % 20) * 30.0 + shift, F.col("l_linenumber") * 20.0 + shift
    number = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)")
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), number.cast("long").alias("word_id"), F.col("l_returnflag").alias("text"),
        (F.col("l_discount") * (10 - shift)).alias("conf"), x.alias("l"), y.alias("t"), (x + 25).alias("r"), (y + 12).alias("b"),
    )


@query("SELECT l_orderkey AS doc_id, 1 AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS word_id, l_partkey % 20 * 30.0::DOUBLE AS l, l_discount * 10 AS conf FROM lineitem")
def iou_merge(spark, d):
    return layout.merge_words(_words(spark, d, 0.0), _words(spark, d, 2.0)).select("doc_id", "page_no", "word_id", "l", "conf")


@query(
    """WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey % 20 * 30.0 AS l, l_returnflag AS text, l_discount * 10 AS conf FROM lineitem)
SELECT doc_id, 1 AS page_no, dense_rank() OVER (PARTITION BY doc_id ORDER BY n)::INTEGER AS line_no, string_agg(text, ' ' ORDER BY l, text) AS text, round(avg(conf), 6) AS conf FROM w GROUP BY doc_id, n"""
)
def ocr_lines(spark, d):
    return layout.line_confidence(layout.lines_of_words(_words(spark, d, 0.0))).withColumn("conf", F.round("conf", 6))


@query(
    """WITH b AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS block_no, l_partkey % 20 * 30.0 AS x0, l_linenumber * 20.0 AS y0, l_returnflag AS text FROM lineitem),
w AS (SELECT *, x0 + 12.5 AS cx, max(x0) OVER p + 25 - min(x0) OVER p AS w FROM b WINDOW p AS (PARTITION BY doc_id)),
g AS (SELECT *, lead(cx) OVER (PARTITION BY doc_id ORDER BY cx, block_no) - cx AS gap FROM w),
cuts AS (SELECT doc_id, list(cx + gap / 2) AS edges FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap DESC, cx) AS r FROM g WHERE gap > 0.05 * w) WHERE r <= 2 GROUP BY doc_id),
c AS (SELECT g.*, coalesce(len(list_filter(edges, lambda x: x < cx)), 0)::INTEGER AS c FROM g LEFT JOIN cuts USING (doc_id)),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, c) AS k FROM c), m AS (SELECT *, min(k) OVER (PARTITION BY doc_id) AS least FROM k)
SELECT doc_id, 1 AS page_no, block_no, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + 25)::DOUBLE AS x1, (y0 + 12)::DOUBLE AS y1, text, CASE WHEN least >= 2 THEN c ELSE 0 END AS col_no FROM m"""
)
def block_columns(spark, d):
    w = _words(spark, d, 0.0)
    return layout.columns_of_blocks(w.select("doc_id", "page_no", F.col("word_id").alias("block_no"), F.col("l").alias("x0"), F.col("t").alias("y0"), F.col("r").alias("x1"), F.col("b").alias("y1"), "text"))


@query("SELECT conv_id AS doc_id, avg(length(trim(text))) < 200 AS scanned FROM conversations WHERE turn <= 3 GROUP BY conv_id")
def scanned_documents(spark, d):
    return layout.scanned(_turns(spark, d), 200.0)


@query(
    r"""SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS md5 FROM documents"""
)
def html_escape(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.escape_html(F.col("text"))).alias("md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | structure.QUERIES | extras.QUERIES | flows.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | structure.SQL | extras.SQL | flows.sql(SQL, extras.SQL)

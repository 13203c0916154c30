"""Queries of what goes through files, streams and scans over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import chunking, confidence, langmodel, layout, ordered, rules, validation
from leafmill.plans import builders, extras
from leafmill.sinks.files import read_back, write_files
from leafmill.sinks.shared import scratch
from leafmill.sources import files, scan, splits
from leafmill.streaming import counters, settle, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql(*others: dict[str, str]) -> dict[str, str]:
    """The SQL of this module; what was written as files equals what other queries make."""
    known = {k: v for other in others for k, v in other.items()}
    return SQL | {
        "written_documents": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5('old') ELSE md5 END AS md5, CASE WHEN doc_id % 3 = 0 THEN 'exists' ELSE 'written' END AS status, 1 AS files FROM ({known['markdown_documents']})",
        "numbered_issues": f"WITH i AS ({known['heading_jumps']}) SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos, issue) AS n, issue FROM i JOIN documents USING (doc_id)",
        "written_artifacts": f"SELECT path, md5 FROM ({known['file_artifacts']})",
        "written_pictures": f"SELECT p.path || '/assets/' || p.file AS path, octet_length(encode(text))::BIGINT AS bytes, md5(text) AS md5 FROM ({known['named_images']}) p JOIN documents USING (doc_id)",
    }


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Files -------------------------------------------------------------------------------------------


@query()
def written_documents(spark, d):
    """Documents as Markdown files, read back; every third has a file already, which stays."""
    from leafmill.plans import catalog

    docs, root = catalog._outputs(spark, d, catalog._sections(spark, d)), scratch(spark, "out")
    path = builders.output_path("", "Markdown")
    write_files(docs.where("doc_id % 3 = 0").select(path.alias("path"), F.lit("old").alias("text")), root)
    told = builders.save(docs, "Markdown", root).select("path", "status")
    number = lambda c: F.regexp_extract(c, r"doc(\d+)\.md$", 1).cast("long")
    held = read_back(spark, root).select(number(F.col("path")).alias("doc_id"), F.md5("content").alias("md5"))
    one = told.groupBy(number(F.col("path")).alias("doc_id")).agg(F.first("status").alias("status"), F.count(F.lit(1)).cast("int").alias("files"))
    return held.join(one, "doc_id").select("doc_id", "md5", "status", "files")


@query()
def written_artifacts(spark, d):
    """Reports and logs of each file, as files read back."""
    root = scratch(spark, "artifacts")
    rows = extras.artifact_rows(spark, d)
    write_files(rows.select("path", "text"), root)
    below = F.regexp_extract("path", r"leafmill-artifacts-[0-9a-f]+/(.*)$", 1)
    return files.texts(spark, root, (".txt", ".log")).select(below.alias("path"), F.md5("text").alias("md5"))


@query()
def written_pictures(spark, d):
    """Pictures of each source under their own names, as files read back; equal ones are written once."""
    root = scratch(spark, "pictures")
    named = extras.picture_rows(spark, d)
    write_files(named.select(F.concat("path", F.lit("/assets/"), "file").alias("path"), "content"), root)
    return read_back(spark, root).select("path", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("md5"))


# Streams -----------------------------------------------------------------------------------------


def _stream(spark: SparkSession, rows: DataFrame, files_: int = 8, per_batch: int | None = None) -> DataFrame:
    """Rows of a table as a stream of files."""
    path = scratch(spark, "stream")
    rows.repartition(files_).write.parquet(path)
    reader = spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def _drained(stream: DataFrame, what: str) -> DataFrame:
    """All that a stream gives for what is there now."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, what)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    """WITH RECURSIVE e AS (SELECT 'f' || user_id AS path, floor(value)::BIGINT % 6 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT path, 0 AS n, -1::BIGINT AS last, 0 AS seen, NULL::VARCHAR AS status, NULL::BIGINT AS size FROM (SELECT DISTINCT path FROM e)
  UNION ALL SELECT r.path, r.n + 1, CASE WHEN done THEN -1 ELSE e.size END, CASE WHEN done THEN 0 ELSE r.seen + 1 END, CASE WHEN whole THEN 'whole' WHEN done THEN 'unfinished' END, e.size
  FROM r JOIN (SELECT * FROM e) e ON e.path = r.path AND e.n = r.n + 1, LATERAL (SELECT e.size = r.last AND e.size > 0 AS whole) w, LATERAL (SELECT whole OR r.seen + 1 >= 20 AS done) x)
SELECT path, status, size, count(*) AS times FROM r WHERE status IS NOT NULL GROUP BY path, status, size"""
)
def settled_files(spark, d):
    """Each event as a look at its user's file: what became of the files, by keyed state over a stream."""
    e = _t(spark, d, "events").select(F.concat(F.lit("f"), "user_id").alias("path"), (F.floor("value") % 6).alias("size"), F.col("event_id").alias("ord"))
    out = _drained(settle.settled(_stream(spark, e), every=None, most=None), "settled")
    return out.groupBy("path", "status", "size").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT path, modified FROM (SELECT DISTINCT event_type || (user_id % 20) AS path, date_trunc('day', ts) AS modified FROM events)")
def rearrived_files(spark, d):
    """Each event as a sight of a file with a time of modification: a file counts once for each such time, however often and in whatever batch it is seen."""
    e = _t(spark, d, "events").select(F.concat("event_type", F.col("user_id") % 20).alias("path"), F.date_trunc("day", "ts").alias("modified"))
    return _drained(watch.once_each(_stream(spark, e, per_batch=2), "400 days", modified="modified"), "once")


@query("SELECT count_if(event_type <> 'error') AS completed, count_if(event_type = 'error') AS failed, count_if(event_type <> 'error') AS sections FROM events")
def stream_counters(spark, d):
    """Counters of a stream that was stopped and started again, from what was observed and without reading its output."""
    bad = F.col("event_type") == "error"
    e = _t(spark, d, "events").select(F.col("event_id").alias("path"), F.when(bad, "failed").otherwise("ok").alias("status"), F.when(~bad, 0).alias("sec_no"))
    stream, out, check = _stream(spark, e, per_batch=3), scratch(spark, "counted"), scratch(spark, "state")
    sums = counters.Counters(out)

    def batch(rows: DataFrame, number: int) -> None:
        rows, seen = counters.observed(rows)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        sums.add(number, seen.get)

    for _ in range(2):
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.createDataFrame([tuple(counters.Counters(out).totals()[k] for k in counters.NAMES)], ", ".join(f"{k} long" for k in counters.NAMES))


# Scans -------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, octet_length(encode(text))::BIGINT AS bytes, 3 AS cells FROM documents")
def csv_documents(spark, d):
    """Documents, line ends and quotes included, as delimited files that are read back in pieces of 64 kB."""
    path = scratch(spark, "csv")
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang")
    docs.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = splits.read_rows(spark, path, delimiter=",", piece=1 << 16).where("row_no > 0")
    c = F.col("cells")
    return rows.select(c[0].cast("long").alias("doc_id"), F.md5(c[1]).alias("md5"), F.octet_length(c[1]).cast("long").alias("bytes"), F.size("cells").alias("cells"))


@query("SELECT event_id, sum(round(value * 100)::BIGINT) OVER w::BIGINT AS cents, row_number() OVER w AS nth FROM events WINDOW w AS (ORDER BY user_id, ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_totals(spark, d):
    """Running sums and numbers over all events in one order."""
    return ordered.running(_t(spark, d, "events"), ["user_id", "ts"], {"cents": F.round(F.col("value") * 100).cast("long")}, "nth").select("event_id", "cents", "nth")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10000")
def first_lines(spark, d):
    """The first 10,000 lines, which is what a table shows, in the order of the file."""
    return ordered.first_rows(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], builders.ROWS)


@query(
    """WITH l AS (SELECT *, octet_length(encode(line))::BIGINT + 1 AS size FROM (SELECT ts, event_id, event_type || ' ' || props AS line FROM events)),
s AS (SELECT *, sum(size) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start, 5000 - max(size) OVER () + 1 AS width FROM l),
f AS (SELECT *, dense_rank() OVER (ORDER BY start // width) - 1 AS file_no FROM s)
SELECT file_no, count(*) AS lines, sum(size)::BIGINT AS bytes, min(event_id) AS first FROM f GROUP BY file_no"""
)
def log_files(spark, d):
    """Log lines in order of time as files of at most 5,000 bytes."""
    lines = _t(spark, d, "events").select("ts", "event_id", F.concat("event_type", F.lit(" "), "props").alias("line"))
    out = ordered.files_of(lines, ["ts", "event_id"], "line", 5000)
    return out.groupBy("file_no").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line").cast("long") + 1).alias("bytes"), F.min("event_id").alias("first"))


@query(
    """WITH r AS (SELECT s_suppkey % 5 AS sheet, s_suppkey, s_suppkey * 100 AS r0, s_suppkey * 100 + (s_suppkey % 3) * 40 + 10 AS r1, s_suppkey % 7 AS c1 FROM supplier), p AS (SELECT event_id % 5 AS sheet, event_id, event_id AS row, event_id % 11 AS col FROM events)
SELECT p.sheet, event_id, s_suppkey AS range FROM p LEFT JOIN r ON p.sheet = r.sheet AND row BETWEEN r0 AND r1 AND col BETWEEN 0 AND c1"""
)
def cells_in_ranges(spark, d):
    """Events as cells of five sheets, each with the range of cells that it is in, if any; ranges are looked up by tiles."""
    s = F.col("s_suppkey")
    rects = _t(spark, d, "supplier").select((s % 5).alias("sheet"), (s * 100).alias("min_row"), (s * 100 + (s % 3) * 40 + 10).alias("max_row"), F.lit(0).alias("min_col"), (s % 7).alias("max_col"), s.alias("range"))
    e = F.col("event_id")
    cells = _t(spark, d, "events").select((e % 5).alias("sheet"), e, e.alias("row"), (e % 11).alias("col"))
    return layout.rectangles_at(cells, rects).select("sheet", "event_id", F.col("rect.range").alias("range"))


# Rules and sources -------------------------------------------------------------------------------


PAIR_SQL = "chr((97 + s_suppkey % 26)::INTEGER) || chr((97 + s_suppkey // 26 % 26)::INTEGER)"


@query(
    f"""WITH RECURSIVE u AS (SELECT (s_nationkey % 4)::INTEGER AS k, array_agg({PAIR_SQL} ORDER BY s_suppkey) AS p, array_agg(upper({PAIR_SQL}) || s_nationkey ORDER BY s_suppkey) AS n FROM supplier WHERE s_suppkey % 9 <> 0 GROUP BY 1),
f AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 9 END AS k, 0 AS i, regexp_replace(text, '[0-9]+', '#', 'g') AS t FROM documents
  UNION ALL SELECT doc_id, f.k, i + 1, replace(t, p[i + 1], n[i + 1]) FROM f JOIN u ON f.k = u.k WHERE i < len(p))
SELECT doc_id, md5(arg_max(t, i)) AS md5 FROM f GROUP BY doc_id"""
)
def rules_by_profile(spark, d):
    """Documents by the rules of their language: a pattern, then a pair of letters for each supplier, every ninth rule off and one no pattern."""
    s, key = _t(spark, d, "supplier"), F.col("s_suppkey")
    pair = F.concat(F.char(97 + key % 26), F.char(97 + F.floor(key / 26) % 26))
    names = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    pairs = s.select(names.alias("profile"), key.alias("ord"), pair.alias("pattern"), F.concat(F.upper(pair), "s_nationkey").alias("replacement"), (key % 9 != 0).alias("enabled"), F.lit(False).alias("use_regex"))
    first = _t(spark, d, "documents").select("lang").distinct().select(F.col("lang").alias("profile"), F.inline(F.array(*[F.struct(F.lit(o).cast("long").alias("ord"), F.lit(p).alias("pattern"), F.lit("#").alias("replacement"), F.lit(True).alias("enabled"), F.lit(True).alias("use_regex")) for o, p in ((-2, "("), (-1, "[0-9]+"))])))
    return rules.apply_profiles(_t(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("profile")), pairs.unionByName(first)).select("doc_id", F.md5("text").alias("md5"))


@query(
    """SELECT 'd' || doc_id || '.' || e AS name, '.' || e AS extension, octet_length(encode(text))::BIGINT AS length, md5(text) AS md5 FROM (SELECT *, ['md', 'html', 'txt', 'md'][doc_id % 4 + 1] AS e FROM documents) WHERE e <> 'txt'"""
)
def scanned_files(spark, d):
    """Documents as files of three kinds, of which two are scanned; files of the third are never opened."""
    root = scratch(spark, "scan")
    kind = F.element_at(F.array(*map(F.lit, ("md", "html", "txt", "md"))), (F.col("doc_id") % 4 + 1).cast("int"))
    write_files(_t(spark, d, "documents").select(F.concat("source", F.lit("/d"), "doc_id", F.lit("."), kind).alias("path"), "text"), root)
    found = scan.read(spark, root).where(F.col("extension").isin(".md", ".html"))
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "extension", "length", F.md5("content").alias("md5"))


@query(
    """WITH d AS (SELECT doc_id, (n_chars // 50)::INTEGER AS n, CASE doc_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 25 WHEN 2 THEN 30 ELSE 20 END AS s FROM documents), r AS (SELECT doc_id, n, CASE WHEN n <= 30 THEN greatest(n, 1) ELSE s END AS s FROM d)
SELECT doc_id, k::INTEGER AS chunk_no, (k * s)::INTEGER AS first, least((k + 1) * s, n)::INTEGER AS last FROM r, LATERAL (SELECT unnest(range(0, greatest(1, (n + s - 1) // s))) AS k)"""
)
def page_plan_by_memory(spark, d):
    """Documents of 50 signs a page in ranges of pages, for workers of 4, 8 and 16 GB and of unknown memory."""
    docs = _t(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 50).cast("int").alias("pages"))
    memory = F.element_at(F.array(F.lit(4.0), F.lit(8.0), F.lit(16.0), F.lit(None).cast("double")), (F.col("doc_id") % 4 + 1).cast("int"))
    return chunking.page_plan_for(docs, "doc_id", "pages", memory)


@query(
    """WITH t AS (SELECT doc_id, lang, doc_id % 4 = 2 AS held_out, regexp_replace(' ' || lower(text) || ' ', '[^\\p{L}]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, lang, held_out, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS g FROM t),
b AS (SELECT doc_id, lang, held_out, (ord(g) * 7919 + ord(g[2:]) * 104729 + ord(g[3:]) * 1299709) % 65536 AS b, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT b, lang, sum(n) AS c FROM b WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL), l AS (SELECT lang, sum(c) AS total FROM c GROUP BY lang),
s AS (SELECT doc_id, l.lang, sum(n * round(ln((coalesce(c, 0) + 0.1::DOUBLE) / (total + 6553.6::DOUBLE)) * 1000))::BIGINT AS s, sum(n)::BIGINT AS n FROM b CROSS JOIN l LEFT JOIN c ON c.b = b.b AND c.lang = l.lang GROUP BY ALL),
r AS (SELECT doc_id, lang, n, s, row_number() OVER o AS k, lead(s) OVER o AS next FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY s DESC, lang))
SELECT d.doc_id, d.doc_id % 4 = 2 AS held_out, coalesce(n, 0) AS grams, CASE WHEN coalesce(n, 0) < 18 THEN 'en' ELSE r.lang END AS lang, CASE WHEN coalesce(n, 0) < 18 THEN 0.0 ELSE round((s - next)::DOUBLE / (n * 1000), 6) END::DOUBLE AS score
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND k = 1"""
)
def modelled_languages(spark, d):
    """Language of every document by trigrams learnt from those that aren't held out."""
    docs = _t(spark, d, "documents")
    model = langmodel.train(docs.where("doc_id % 4 <> 2"))
    return langmodel.rate(docs, model).select("doc_id", (F.col("doc_id") % 4 == 2).alias("held_out"), "grams", "lang", F.round("score", 6).alias("score"))


@query()
def numbered_issues(spark, d):
    """Issues of the documents of a source, numbered; one source may hold most of them."""
    from leafmill.plans import catalog

    return validation.issue_rows(catalog._headed(spark, d), _t(spark, d, "documents"), "source")


@query(
    """SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, k) AS n, doc_id AS file, w AS warning FROM (
  SELECT lang, doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT lang, doc_id, list_filter([CASE WHEN toxic = 1 THEN 't' || doc_id END, CASE WHEN quality = 0 THEN 'q' || doc_id END], lambda x: x IS NOT NULL) AS ws FROM labels JOIN documents USING (doc_id)))"""
)
def numbered_warnings(spark, d):
    """Warnings of the documents of a language, numbered in the order of their files."""
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    each = F.array(F.when(F.col("toxic") == 1, F.concat(F.lit("t"), "doc_id")), F.when(F.col("quality") == 0, F.concat(F.lit("q"), "doc_id")))
    return confidence.warning_rows(rows.select("lang", F.col("doc_id").alias("file"), F.filter(each, lambda w: w.isNotNull()).alias("warnings")), "lang")

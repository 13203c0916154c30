"""Structure counts, heading and link checks, readability, and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.kernels import text_counts
from leafmill.functions.text import let, line_states, strip
from leafmill.operators import ordered

# What counts as a heading, a table, an image, a page mark and a link.
HEADING = "(?m)^(#{1,6})\\s+\\S"
TABLE = "(?m)^\\|[\\s:]*-+[\\s:]*\\|"
IMAGE = "!\\[([^\\]]*)\\]\\(([^)]+)\\)"
PAGE = '(?i)<a\\s+id="page-(\\d+)"'
LINK = "(?<!!)\\[([^\\]]+)\\]\\(([^)]+)\\)"


def _plain(md: Column) -> Column:
    """Text whose words count: no fenced code, no front matter, marks as spaces (so that nothing is a tag any more).

    Each step runs only on texts that have what it takes away.
    """
    c = F.when(F.contains(md, F.lit("```")), F.regexp_replace(md, "(?s)```.*?```", "")).otherwise(md)
    return let(
        let(c, lambda c: F.when(F.startswith(c, F.lit("---\n")), F.regexp_replace(c, "(?s)\\A---\\n.*?\\n---", "")).otherwise(c)),
        lambda c: F.when(c.rlike("[#*|`\\[\\]()>_~]"), F.translate(c, "#*|`[]()>_~", " " * 11)).otherwise(c),
    )


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """Adds _n, the counts of the text whose words count, which all reports share; null counts as empty."""
    return docs.withColumn("_n", text_counts(_plain(F.coalesce(F.col(text), F.lit("")))))


def grade_label(grade: Column) -> Column:
    up = F.ceil(grade).cast("string")
    return (
        F.when(grade <= 5, "Very Easy (Grade 5)")
        .when(grade <= 8, F.concat(F.lit("Easy (Grade "), up, F.lit(")")))
        .when(grade <= 12, F.concat(F.lit("Standard (Grade "), up, F.lit(")")))
        .when(grade <= 16, "College Level")
        .otherwise("Graduate Level")
    )


def _counts(docs: DataFrame, text: str) -> DataFrame:
    c = F.coalesce(F.col(text), F.lit(""))
    n = {"heading_count": HEADING, "table_count": TABLE, "image_count": IMAGE, "page_count": PAGE, "link_count": LINK}
    return docs.withColumns({k: F.regexp_count(c, F.lit(p)) for k, p in n.items()} | {"word_count": F.col("_n.tokens")})


def _grades(docs: DataFrame) -> DataFrame:
    d = docs.withColumns({"n_words": F.greatest("_n.words", F.lit(1)), "n_sentences": F.greatest("_n.sentences", F.lit(1)), "n_syllables": F.col("_n.syllables")})
    grade = F.lit(0.39) * (F.col("n_words") / F.col("n_sentences")) + F.lit(11.8) * (F.col("n_syllables") / F.col("n_words")) - F.lit(15.59)
    d = d.withColumn("grade", F.greatest(F.lit(0.0), F.least(F.lit(30.0), F.round(grade, 1))))
    return d.withColumn("grade_label", grade_label(F.col("grade")))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and six counts; no shuffle."""
    return _counts(_counted(docs, text), text).drop("_n")


def grades(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the Flesch-Kincaid grade from 0 to 30, grade_label, and what the grade is made of."""
    return _grades(_counted(docs, text)).drop("_n")


def validated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``counts`` and ``grades`` of each document, from one plain text."""
    return _grades(_counts(_counted(docs, text), text)).drop("_n")


def headings_of(text: Column) -> Column:
    """array of struct(pos, level, title) of headings outside fences and front matter."""
    hit = "^(#{1,6})\\s+(\\S.*)$"
    lines = F.transform(line_states(text), lambda x, i: F.struct(i.alias("pos"), x["line"].alias("line"), x["state"].alias("state")))
    found = F.filter(lines, lambda x: ~x["state"].isin("m", "c") & x["line"].rlike(hit))
    level, title = lambda x: F.length(F.regexp_extract(x["line"], hit, 1)), lambda x: strip(F.regexp_extract(x["line"], hit, 2))
    return F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), level(x).alias("level"), title(x).alias("title")))


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, level, title) of headings outside fences and front matter; no shuffle, and repeated rows stay apart."""
    return docs.select(key, F.explode(headings_of(F.col(text))).alias("h")).select(key, "h.*")


def heading_jumps(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, issue) where a heading is more than one level below the one before it."""

    def jumps(hs: Column) -> Column:
        pairs = F.transform(hs, lambda h, i: F.struct(h["pos"].alias("pos"), F.when(i > 0, F.get(hs, i - 1)["level"]).alias("last"), h["level"].alias("level")))
        return F.filter(pairs, lambda p: p["level"] > p["last"] + 1)

    found = docs.select(key, F.explode(let(headings_of(F.col(text)), jumps)).alias("j")).select(key, "j.*")
    return found.select(key, "pos", F.format_string("H%d jumps to H%d (skipped H%d)", F.col("last"), F.col("level"), F.col("last") + 1).alias("issue"))


def slug(title: Column) -> Column:
    """Anchor of a heading."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(title)), "(?U)[^\\w\\s-]", ""), "(?U)\\s+", "-")


def broken_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, label, anchor) of links to an anchor that the document has neither as a page nor as a heading."""
    c = F.coalesce(F.col(text), F.lit(""))
    pair = F.arrays_zip(F.regexp_extract_all(c, F.lit(LINK), F.lit(1)).alias("label"), F.regexp_extract_all(c, F.lit(LINK), F.lit(2)).alias("target"))
    links = docs.select(key, F.explode(pair).alias("l")).select(key, F.col("l.label").alias("label"), F.col("l.target").alias("target"))
    links = links.where(F.startswith("target", F.lit("#")) & (F.length("target") > 1)).select(key, "label", F.expr("substring(target, 2)").alias("anchor"))
    pages = docs.select(key, F.explode(F.regexp_extract_all(c, F.lit(PAGE), F.lit(1))).alias("n")).select(key, F.concat(F.lit("page-"), "n").alias("anchor"))
    there = pages.unionByName(headings(docs, key, text).select(key, slug(F.col("title")).alias("anchor"))).distinct()
    return links.join(there, [key, "anchor"], "left_anti").select(key, "label", "anchor")


def issues(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, issues): what is wrong with the headings of a document in their order, then its broken links by text."""
    found = _found(docs, key, text).select(key, F.struct("part", "pos", "issue").alias("i"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["issue"]).alias("issues"))


def _found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, pos, issue): one row for each issue."""
    jumps = heading_jumps(docs, key, text).select(key, F.lit(0).alias("part"), F.col("pos").alias("pos"), F.col("issue").alias("issue"))
    broken = F.format_string("Broken anchor: [%s](#%s)", "label", "anchor")
    links = broken_links(docs, key, text).select(key, F.lit(1).alias("part"), F.lit(0).alias("pos"), broken.alias("issue"))
    return jumps.unionByName(links)


def issue_rows(docs: DataFrame, groups: DataFrame, *by: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, n, issue): issues of all documents of a group, numbered in order of their keys, one row for each.

    ``groups`` tells the columns ``by`` of each key; a key that it lacks is left
    out.  Unlike ``all_issues`` this puts no group into one row, so groups may be
    of any size.
    """
    rows = _found(docs, key, text).join(groups.select(key, *by), key)
    return ordered.numbered_within(rows, by, [key, "part", "pos", "issue"], "n").select(*by, "n", "issue")


def all_issues(found: DataFrame, key: str = "doc_id", *by: str) -> DataFrame:
    """(by, issues): issues of all documents of a group in order of their keys, in one row; ``issue_rows`` is for groups of any size."""
    return found.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key, "issues"))), lambda x: x["issues"])).alias("issues"))


def roll_up(validated: DataFrame, *by: str) -> DataFrame:
    """Sums of counts and the mean of grades over zero, with its label, for each group."""
    names = ["heading_count", "table_count", "image_count", "page_count", "link_count", "word_count"]
    mean = F.coalesce(F.avg(F.when(F.col("grade") > 0, F.col("grade"))), F.lit(0.0))
    out = validated.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), *[F.sum(n).alias(n) for n in names], mean.alias("mean"))
    return out.withColumn("avg_grade", F.round("mean", 1)).withColumn("label", grade_label(F.col("mean"))).drop("mean")

"""URL filters: rules first, then trust and distrust propagated over the host graph.

Main path: DataFrame functions only.  Hosts with a page that a rule allows are
trusted seeds and hosts with a page that a rule blocks are blocked seeds; a
personalised PageRank runs from the former along the links, another from the
latter against them (who links to a blocked host is suspect).  A host is blocked
where any distrust reaches it and is over ``threshold`` times its trust: scores
shrink with the number of seeds and links, so no fixed bound is put on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import durable, forget

Rule = tuple[str, str]
#: (verdict, rule); a rule is a host and a path from its first slash on.
RULES: tuple[Rule, ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Links with a host of their own in the attributes of a page.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equal rules the first given counts."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def node_of(host: Column) -> Column:
    """The host's name in the graph: without user and port, A-Z lower-cased."""
    return lower_ascii(F.regexp_replace(host, r"(?s)^.*@|:\d*$", ""))


def edges(judged: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, counted before and after the shuffle; no row for each page."""
    link = F.regexp_extract_all(F.coalesce(F.col("_html"), F.lit("")), F.lit(LINK), F.lit(1))
    return (
        judged.where(F.col("_node") != "")
        .select(F.col("_node").alias("src"), F.explode(link).alias("dst"))
        .withColumn("dst", node_of(F.col("dst")))
        .where((F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )


def propagate(links: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(host, score): personalised PageRank from ``seeds`` (host) along ``links`` (src, dst, w).

    ``rounds`` steps of r' = (1 - damping) s + damping P r; weight that leaves
    the graph at a host without links is dropped, which scales all scores alike
    within a step.  Each round is one join and one sum, kept as a table in the
    shared folder so that the plan doesn't grow and a lost executor costs one
    round at most.
    """
    out = durable(links.groupBy("src").agg(F.sum("w").alias("total")), "totals")
    step = durable(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "links")
    forget(out)
    start = durable(seeds.select("host", F.lit(1.0 / max(1, seeds.count())).alias("s")), "seeds")
    rank = start = start.withColumn("score", F.col("s"))
    for _ in range(rounds):
        moved = step.join(rank, step["src"] == rank["host"]).select(F.col("dst").alias("host"), (F.lit(damping) * F.col("p") * F.col("score")).alias("score"))
        new = durable(
            moved.unionByName(start.select("host", (F.lit(1 - damping) * F.col("s")).alias("score"))).groupBy("host").agg(F.sum("score").alias("score")), "rank"
        )
        if rank is not start:
            forget(rank)
        rank = new
    forget(step)
    return rank


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    rounds: int = 12,
    damping: float = 0.85,
    threshold: float = 1.0,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row for each page.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and has no scores: it is allowed.  So is a host that no seed reaches.  A
    host can be a seed of both kinds; without links seeds keep their own scores.  In the graph hosts go without user and port.  Null html has no links.  Repeated rows
    stay repeated, an empty table gives an empty result, other columns aren't
    read.
    """
    judged = (
        pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
        .withColumn("_host", host_of(F.col("_url")))
        .withColumn("_path", path_of(F.col("_url")))
        .withColumn("_node", node_of(F.col("_host")))
        .withColumn("_fit", rule_of(F.col("_host"), F.col("_path"), rules))
    )
    links = durable(edges(judged), "edges")
    page = judged.select("_key", "_host", "_node", "_path", "_fit")
    seed = durable(page.where(F.col("_fit").isNotNull()).select(F.col("_node").alias("host"), F.col("_fit.verdict").alias("v")).distinct(), "seeds")
    trust = propagate(links, seed.where("v = 'allow'").select("host"), rounds, damping)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = propagate(back, seed.where("v = 'block'").select("host"), rounds, damping)
    # Written before the join, whose sides adaptive execution can split then: one host may have a third of all pages.
    scores = durable(
        trust.select("host", F.col("score").alias("t"), F.lit(0.0).alias("d"))
        .unionByName(distrust.select("host", F.lit(0.0).alias("t"), F.col("score").alias("d")))
        .groupBy("host")
        .agg(F.sum("t").alias("t"), F.sum("d").alias("d")),
        "scores",
    )
    for done in (links, seed, trust, distrust):
        forget(done)
    page = page.join(scores, F.col("_node") == F.col("host"), "left")
    t, d = F.coalesce("t", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
    own = F.when((d > 0) & (d > F.lit(threshold) * t), F.lit("block")).otherwise(F.lit("allow"))
    return page.select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_fit.rule").alias("rule"),
        F.coalesce(F.col("_fit.verdict"), own).alias("verdict"),
        t.alias("trust"),
        d.alias("distrust"),
    )


def judge_sql(pages: str = "pages", rules: Sequence[Rule] = RULES, rounds: int = 12, damping: float = 0.85, digits: int = 12) -> str:
    """DuckDB SQL of ``judge`` with the rounds of both walks written out; scores are rounded."""
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    quoted = lambda x: x.replace("'", "''")
    fits = {}
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits[rule] = verdict, f"(host = '{name}' OR suffix(host, '.{name}')) AND starts_with(path, '{slash}{rest}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fit} THEN '{(rule, verdict)[k]}'" for rule, (verdict, fit) in fits.items()) + " END"
    node = lambda x: lower(f"regexp_replace(regexp_replace({x}, '(?s)^.*@', ''), ':[0-9]*$', '')")
    sql = f"""WITH u AS (SELECT page_id, html, {lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM {pages}),
g AS (SELECT *, {node("host")} AS a, {case(0)} AS rule, {case(1)} AS v FROM u),
x AS (SELECT a, {node("b")} AS b FROM (SELECT a, unnest(regexp_extract_all(coalesce(html, ''), '{quoted(LINK)}', 1)) AS b FROM g WHERE a <> '')),
l AS MATERIALIZED (SELECT a, b, count(*)::DOUBLE AS w FROM x WHERE b <> '' AND a <> b GROUP BY a, b),
ft AS MATERIALIZED (SELECT a AS s, b AS t, w / sum(w) OVER (PARTITION BY a) AS q FROM l), fd AS MATERIALIZED (SELECT b AS s, a AS t, w / sum(w) OVER (PARTITION BY b) AS q FROM l)"""
    for name, verdict in (("t", "allow"), ("d", "block")):
        sql += f",\nh{name} AS MATERIALIZED (SELECT a AS h, 1.0 / count(*) OVER () AS s FROM (SELECT DISTINCT a FROM g WHERE v = '{verdict}')), {name}0 AS MATERIALIZED (SELECT h, s AS r FROM h{name})"
        for k in range(rounds):
            sql += f",\n{name}{k + 1} AS MATERIALIZED (SELECT h, sum(r) AS r FROM (SELECT t AS h, {damping} * q * r AS r FROM f{name} JOIN {name}{k} ON s = h UNION ALL SELECT h, {1 - damping} * s FROM h{name}) GROUP BY h)"
    return sql + f"""
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN coalesce(d.r, 0) > coalesce(t.r, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(t.r, 0), {digits})::DOUBLE AS trust, round(coalesce(d.r, 0), {digits})::DOUBLE AS distrust FROM g LEFT JOIN t{rounds} t ON t.h = a LEFT JOIN d{rounds} d ON d.h = a"""

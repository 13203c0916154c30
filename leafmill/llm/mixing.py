"""Mixing sources to target weights by Poisson replication (DataFrame operations only).

Each source has a mean repetition rate: its target share of the mixture over
its share of the corpus, times ``epochs``.  A document's number of copies is a
Poisson variable of that mean, found by inverting the distribution at a uniform
number hashed from the seed and the document, so that a rerun or a retried task
gives the same mixture and no state is shared.  Copies are then dealt out and
ordered by a hash of their own: a global shuffle with one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import durable

#: Steps of the inverted distribution beyond its mean: 12 standard deviations and 24, so that
#: what is left out has a probability far below the 2**-52 that a hashed number can resolve.
TAIL = (12.0, 24.0)
#: Sources up to which their rates are broadcast.
BROADCAST_ROWS = 50_000
#: Rate from which the distribution is summed from its lower tail on, as exp(-rate) loses digits from 708 on.
LARGE = 700


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the seed and the parts; the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None, source: str = "source", epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): documents of each source and its target repetition rate.

    ``weights`` gives relative target weights by source; a source that it
    doesn't name has weight 1 (None: every source has).  Null is a source of its
    own.  The weights of the sources that are there are scaled to sum to one.
    """
    count = docs.groupBy(F.col(source).alias("_src")).agg(F.count(F.lit(1)).alias("_n"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("_src").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    count = durable(count.withColumn("_w", weight), "sources")
    documents, weights_sum = count.agg(F.sum("_n").cast("double"), F.sum("_w")).first()
    return count.select("_src", "_n", (F.lit(float(epochs)) * F.col("_w") / F.lit(weights_sum) * F.lit(documents) / F.col("_n")).alias("_rate"))


def poisson_quantile(rate: Column, u: Column) -> Column:
    """The smallest k with P(X <= k) > u for X of that mean: the inverted distribution.

    The sum runs over an array of terms, each the one before it times rate / k.
    It starts at 0, or for rates over ``LARGE`` at the lower end of ``TAIL``, whose
    term comes from Stirling's series.
    """
    reach = F.lit(TAIL[0]) * F.sqrt(rate) + F.lit(TAIL[1])
    low = F.when(rate > LARGE, F.floor(rate - reach)).otherwise(F.lit(0)).cast("long")
    k = F.greatest(low, F.lit(1)).cast("double")
    stirling = F.exp(k - rate + k * F.log(rate / k) - F.log(F.lit(2 * math.pi) * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k))
    term = F.when(rate > LARGE, stirling).otherwise(F.exp(-rate))
    found = F.aggregate(
        F.sequence(low + 1, F.ceil(rate + reach).cast("long")),
        F.struct(term.alias("p"), term.alias("c"), low.alias("k")),
        lambda s, k: F.when(s["c"] > u, s).otherwise(
            F.struct((s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"), k.alias("k"))
        ),
    )
    return found["k"].cast("int")


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    *,
    key: str = "doc_id",
    source: str = "source",
    seed: int = 17,
    epochs: float = 1.0,
    partitions: int | None = None,
) -> DataFrame:
    """The mixture: columns of ``docs``, copy_no int (from 1) and shuffle_key double.

    The expected number of copies is ``epochs`` times the number of documents,
    shared between the sources as the weights say.  Rows with equal keys (null
    is one) share their draw: both or neither have the same number of copies.
    An empty table gives an empty mixture.  Columns named copy_no or shuffle_key
    are replaced.  Rates go to the documents through a table of one row for each
    source; it is broadcast up to ``BROADCAST_ROWS`` rows and else joined by
    shuffle, where adaptive execution splits a hot source.
    """
    names = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    rate = rates(docs, weights, source, epochs)
    if rate.count() <= BROADCAST_ROWS:
        rate = F.broadcast(rate)
    # Rows travel as one value, so no name of theirs can clash.
    rows = docs.select(F.struct(*names).alias("row"), F.col(key).alias("key"), F.col(source).alias("source"))
    joined = rows.join(rate, F.col("source").eqNullSafe(F.col("_src")), "inner")
    copies = poisson_quantile(F.col("_rate"), uniform(seed, F.lit("copies"), F.col("key")))
    out = (
        joined.withColumn("copies", copies)
        .where(F.col("copies") > 0)
        .select("row", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
        .withColumn("shuffle_key", uniform(seed, F.lit("order"), F.col("key"), F.col("copy_no")))
    )
    dealt = out.repartition(partitions, "shuffle_key") if partitions else out.repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key", "key", "copy_no").select("row.*", "copy_no", "shuffle_key")


def mix_sql(docs: str = "documents", seed: int = 17, epochs: float = 1.0, columns: str = "doc_id, source, text") -> str:
    """DuckDB SQL of ``mix`` with equal weights; the recursion sums the distribution as long as it is below the draw."""
    u = "(('0x' || substr(md5({}), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0"
    return f"""
WITH RECURSIVE rate AS (
  SELECT source AS src, {epochs} * 1.0 / count(*) OVER () * sum(n) OVER ()::DOUBLE / n AS lam
  FROM (SELECT source, count(*) AS n FROM {docs} GROUP BY source)
), cdf(src, lam, k, p, c) AS (
  SELECT src, lam, 0, exp(-lam), exp(-lam) FROM rate
  UNION ALL
  SELECT src, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) FROM cdf
  WHERE k < ceil(lam + 12 * sqrt(lam) + 24)
), lists AS (SELECT src, list(c ORDER BY k) AS cs FROM cdf GROUP BY src),
drawn AS (
  SELECT d.*, l.cs, {u.format(f"'{seed}|copies|' || coalesce(doc_id::VARCHAR, '')")} AS u
  FROM {docs} d JOIN lists l ON d.source IS NOT DISTINCT FROM l.src
), copied AS (
  SELECT *, unnest(range(1, len(list_filter(cs, lambda x: x <= u)) + 1)) AS copy_no FROM drawn
)
SELECT {columns}, copy_no::INTEGER AS copy_no, {u.format(f"'{seed}|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no::VARCHAR")} AS shuffle_key
FROM copied"""

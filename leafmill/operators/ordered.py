"""Running numbers and sums in a global order, without one task that sees all rows.

Rows are cut into ranges of the order and written with the number of their range.
The sums of the ranges, one row for each, give what lies before a range; within
it a window adds up.  Two passes over the rows, both parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.sinks.shared import durable

#: Ranges that rows are cut into, at most; their sums go through the driver.
RANGES = 4096


def running(rows: DataFrame, order: Sequence[str], sums: dict[str, Column], number: str | None = None, ranges: int | None = None) -> DataFrame:
    """``rows`` with a column for each of ``sums``: the sum of its values up to and with the row, in the order of the columns ``order``.

    ``number`` names a column of running numbers from 1.  Rows that are equal in
    ``order`` come in any order among themselves, but consistently over all
    columns.  Null values count as zero; nulls in ``order`` come first.  Longs
    stay exact.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    parts = min(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES)
    values = {f"v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(sums.values())}
    if number:
        values[f"v{len(values)}"] = F.lit(1).cast("long")
    names = [*sums, *([number] if number else [])]
    # The row travels as one value, so that its names can't clash; equal rows are told apart by a number of their own.
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in order], F.monotonically_increasing_id().alias("own")).alias("o"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"), *[v.alias(k) for k, v in values.items()])
    cut = durable(packed.repartitionByRange(parts, "o").withColumn("part", F.spark_partition_id()), "ranges")
    totals = cut.groupBy("part").agg(*[F.sum(v).alias(v) for v in values]).orderBy("part").collect()
    before, so_far = [], dict.fromkeys(values, 0)
    for t in totals:
        before.append((t["part"], *so_far.values()))
        so_far = {v: so_far[v] + t[v] for v in values}
    types = {f.name: f.dataType.simpleString() for f in cut.agg(*[F.sum(v).alias(v) for v in values]).schema.fields}
    offsets = spark.createDataFrame(before, "part int" + "".join(f", b{v} {types[v]}" for v in values))
    window = Window.partitionBy("part").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(offsets), "part").select("r", *[(F.sum(v).over(window) + F.col(f"b{v}")).alias(v) for v in values])
    return out.select("r.*", *[F.col(v).alias(n) for v, n in zip(values, names, strict=True)])


def first_rows(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in an order, whatever n is: no task holds them, unlike those of a limit."""
    numbered = running(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)]), [f"k{i}" for i in range(len(order))], {}, "nth")
    return numbered.where(F.col("nth") <= n).select("row.*")


def numbered_within(rows: DataFrame, by: Sequence[str], order: Sequence[str], number: str) -> DataFrame:
    """``rows`` with running numbers from 1 within each group of the columns ``by``, in the order of the columns ``order``.

    No task sees a whole group, however large: numbers run over all rows, and the
    number that each group begins after is taken off.  Nulls in ``by`` are a group;
    rows that are equal in ``order`` come in any order among themselves.
    """
    b, k = [f"b{i}" for i in range(len(by))], [f"k{i}" for i in range(len(order))]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[F.col(f"`{c}`").alias(n) for n, c in zip([*b, *k], [*by, *order], strict=True)])
    many = durable(running(packed, [*b, *k], {}, "nth").select("row", *b, "nth"), "numbered")
    # Written, so that the side that groups isn't summed right under the join and a large group can be split.
    first = durable(many.groupBy(*b).agg((F.min("nth") - 1).alias("before")), "groups")
    same = [many[x].eqNullSafe(first[x]) for x in b]
    out = many.join(first, same) if b else many.crossJoin(F.broadcast(first))
    return out.select("row.*", (F.col("nth") - F.col("before")).alias(number))


def files_of(lines: DataFrame, order: Sequence[str], text: str, most: int) -> DataFrame:
    """``lines`` with ``file_no`` from 0 on, in order: no file has over ``most`` bytes of text, each line with its end counted.

    A line longer than ``most`` has a file of its own.  Files are cut at even
    places of the running size, so the number of a line follows from what
    lies before it alone.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    short = F.when(size <= most, size).otherwise(0)
    longest = lines.agg(F.max(short)).first()[0] or 1
    width = max(1, most - longest + 1)
    many = running(lines, order, {"bytes_before": short, "long_before": (size > most).cast("long")})
    start = F.col("bytes_before") - short
    # A long line begins a new file, and so does what follows it.
    place = F.struct(F.floor(start / width).alias("at"), F.col("long_before").alias("longs"), (size > most).alias("alone"))
    places = many.select(place.alias("p")).distinct().select("p", F.col("p.at").alias("at"), F.col("p.longs").alias("longs"), (~F.col("p.alone")).alias("short"))
    numbered = running(places, ["at", "longs", "short"], {}, "file_no").select("p", (F.col("file_no") - 1).alias("file_no"))
    return many.withColumn("p", place).join(numbered, "p").drop("p", "bytes_before", "long_before")

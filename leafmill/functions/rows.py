"""Rows that travel as one value, so that columns of any name pass through an operator untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, **known: str | Column) -> DataFrame:
    """(row, ...): all columns of ``df`` as one value, and beside it those that an operator works with, under its own names."""
    held = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(None)
    return df.select(held.alias("row"), *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in known.items()])


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns out of ``row``: those in ``new`` replaced in their place, others of ``new`` added at the end."""
    kept = [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]
    return rows.select(*kept, *[c.alias(n) for n, c in new.items() if n not in columns])

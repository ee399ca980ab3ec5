"""The uniform result: the first ``limit`` items, and counts over all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class ListResult:
    """``items`` in order; ``meta`` has one row: total_count, truncated, limit; ``summary`` has (dimension, key, n)."""

    items: DataFrame
    meta: DataFrame
    summary: DataFrame | None


def list_result(rows: DataFrame, order: list[Column], limit: int, by: dict[str, Column] | None = None) -> ListResult:
    """Top ``limit`` rows by a total order, and summaries over all rows; exactly ``limit`` rows are not truncated.

    The summaries of several dimensions are one aggregation over exploded (dimension, key) pairs.
    """
    meta = rows.agg(F.count("*").alias("total_count")).select("total_count", (F.col("total_count") > limit).alias("truncated"), F.lit(limit).alias("limit"))
    summary = None
    if by:
        pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("dimension"), key.cast("string").alias("key")) for name, key in by.items()))).alias("p")
        summary = rows.select(pairs).groupBy("p.dimension", "p.key").agg(F.count("*").alias("n"))
    return ListResult(rows.orderBy(*order).limit(limit), meta, summary)


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``; partial minima go before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(*order, *(c for c in rest if c not in order))
    return rows.groupBy(*keys).agg(F.min(packed).alias("_first")).select(*keys, *(F.col("_first")[c].alias(c) for c in rest))


def first_sites(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order``; a running limit before the shuffle keeps groups small."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("site", place).where(F.col("site") <= n)

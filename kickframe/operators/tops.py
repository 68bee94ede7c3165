"""Dedupe, best-of and top-k as mergeable aggregates where possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: Sequence[str], filled: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the one with most non-null ``filled`` columns, then the lowest ``order``.

    An aggregate with map-side combine, so a group of many copies never meets in one sort.
    """
    score = sum((F.col(c).isNotNull().cast("int") for c in filled), F.lit(0))
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-score).alias("s"), order.alias("o"))).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """First row per key in an explicit order."""
    return keep_best(df, keys, [], order)


def keep_last(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Last row per key in an explicit order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """Top k per key; the filter on the row number lets Spark cut each partition before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def last_n_dates(df: DataFrame, ts: str, n: int) -> DataFrame:
    """Rows of the last n distinct dates; the date list is bounded by the calendar."""
    day = F.to_date(ts)
    dates = df.select(day.alias("_d")).distinct().orderBy(F.desc("_d")).limit(n)
    return df.withColumn("_d", day).join(dates, "_d", "left_semi").drop("_d")


def common_values(df: DataFrame, value: str, n: int) -> DataFrame:
    """Most frequent values with counts."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(n)


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows under a total order: a report whose length the caller names."""
    return df.orderBy(*order).limit(n)

"""Audits as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions.cols import is_true


def check_counts(df: DataFrame, checks: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows and, per check, the number of rows that violate it; one aggregation."""
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.count_if(is_true(c)).alias(n) for n, c in checks.items()]]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table of null rates, all columns in one pass."""
    stats = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("null_rate")) for c in columns])
    return df.agg(stats.alias("s")).select(F.inline("s"))


def ranges(df: DataFrame, columns: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Minimum, maximum, mean, missing and out-of-range counts per column in one pass."""
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"), F.avg(c).alias("mean"),
            F.count_if(F.col(c).isNull()).alias("missing"), F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("outside"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def prediction_health(df: DataFrame, minimum: float = 0.95) -> DataFrame:
    """Nulls, complement sums, evidence and price coverage, and the verdict."""
    n = F.count(F.lit(1))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = df.agg(
        n.alias("rows"),
        F.count_if(F.col("p_over").isNull() | F.col("p_btts").isNull()).alias("null_probs"),
        F.count_if(F.abs(F.col("p_over") + F.col("p_under") - 1) > 1e-6).alias("bad_sums"),
        share((F.col("press_n_h") > 0) & (F.col("press_n_a") > 0)).alias("press_share"),
        share((F.col("xg_n_h") > 0) & (F.col("xg_n_a") > 0)).alias("xg_share"),
        share(F.col("odds_over").isNotNull() & F.col("odds_under").isNotNull()).alias("odds_share"),
    )
    clean = (F.col("null_probs") == 0) & (F.col("bad_sums") == 0)
    return out.withColumn("ok", clean & (F.least("press_share", "xg_share", "odds_share") >= minimum))


def reconcile_skips(expected: DataFrame, produced: DataFrame, skipped: DataFrame, reasons: Sequence[str], max_ratio: float = 0.10) -> DataFrame:
    """Expected = produced + skipped, every reason known, skip ratio bounded."""
    e = expected.agg(F.count(F.lit(1)).alias("expected"))
    p = produced.agg(F.count(F.lit(1)).alias("c")).select("c").scalar()
    s = skipped.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("reason").isin(list(reasons))).alias("odd")).alias("s")).select("s").scalar()
    out = e.select("expected", p.alias("produced"), s.alias("_s")).select("expected", "produced", F.col("_s.n").alias("skipped"), F.col("_s.odd").alias("unknown_reasons"))
    ratio = F.try_divide("skipped", "expected")
    ok = (F.col("expected") == F.col("produced") + F.col("skipped")) & (F.col("unknown_reasons") == 0) & (ratio <= max_ratio)
    return out.withColumns({"skip_ratio": ratio, "ok": ok})


def stage_drops(stages: Sequence[tuple[str, DataFrame]], max_drop: float = 0.05) -> DataFrame:
    """Row counts along a chain of stages with the drop against the stage before."""
    from pyspark.sql import Window as W

    out = None
    for i, (name, df) in enumerate(stages):
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows")
        out = part if out is None else out.unionByName(part)
    prev = F.lag("rows").over(W.orderBy("step"))  # one row per stage
    drop = F.try_divide(prev - F.col("rows"), prev)
    return out.withColumns({"drop": drop, "fails": is_true(drop > max_drop)})


def leakage_scan(df: DataFrame, features: Sequence[str], target: str, equal_limit: float = 0.999, corr_limit: float = 0.999) -> DataFrame:
    """Equality rate and absolute correlation of every feature with the target, in one aggregation."""
    y = F.col(target).cast("double")
    rows = [
        F.struct(
            F.lit(c).alias("feature"), F.avg((F.col(c).cast("double") == y).cast("double")).alias("equal_rate"), F.abs(F.corr(F.col(c).cast("double"), y)).alias("abs_corr")
        )
        for c in features
    ]
    long = df.agg(F.array(*rows).alias("s")).select(F.inline("s"))
    return long.withColumn("leaks", is_true(F.col("equal_rate") >= equal_limit) | is_true(F.col("abs_corr") >= corr_limit))

"""Exact quantiles per key without holding a key's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.operators.ordered import running


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles ``probs[name] = p`` of the non-null values per key.

    Values are counted first (duplicates collapse map-side); exact ranks are running counts along the values, in slices of
    bounded row counts for keys of many values.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counted = df.filter(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = running(counted, keys, ["_v"], {"_before": F.col("_n")}, F.col("_v"))
    ranked = ranked.join(totals, keys) if keys else ranked.withColumn("_total", totals.select("_total").scalar())
    picks, out = [], []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}_{name}"))
        frac = pos - F.floor(pos)
        out.append((F.col(f"_lo_{name}") + frac * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    got = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    return got.select(*keys, *out)

"""Small numeric and null-handling column functions shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str, lo, hi) -> Column:
    """Value limited to [lo, hi]; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, _lit(lo)), _lit(hi)))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null when the denominator is null or zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def is_true(cond: Column) -> Column:
    """Comparisons with a missing value count as false, so gates fail closed."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    return is_true(cond).cast("int")


def mean_present(*cols: Column | str) -> Column:
    """Row mean over the non-null arguments; null when all are missing."""
    cs = [col(c) for c in cols]
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    return F.try_divide(total, n)


def weighted_present(parts: Sequence[tuple[Column, Column, float]]) -> Column:
    """Weighted mean over present components, weights renormalised; parts = (value, present, weight)."""
    num = sum((F.when(p, F.lit(w) * v).otherwise(F.lit(0.0)) for v, p, w in parts), F.lit(0.0))
    den = sum((F.when(p, F.lit(w)).otherwise(F.lit(0.0)) for _, p, w in parts), F.lit(0.0))
    return F.try_divide(num, den)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(is_true(c), F.lit(label)) for c, label in pairs]))


def band(diff: Column | str, width: float = 150.0) -> Column:
    """Strength band from a rating difference."""
    d = col(diff)
    return F.when(d >= width, "BULLY").when(d <= -width, "DOG").otherwise("PEER")


def zscore(value: Column | str, mean: Column | str, std: Column | str) -> Column:
    """z, or 0 where the spread is zero or anything is missing."""
    v, m, s = col(value), col(mean), col(std)
    return F.when((s > 1e-9) & v.isNotNull() & m.isNotNull(), (v - m) / s).otherwise(F.lit(0.0))


def unix(ts: Column | str) -> Column:
    """Seconds since the epoch for timestamp and timestamp_ntz alike."""
    return F.unix_timestamp(col(ts).cast("timestamp"))


def ladder(value: Column | str, steps: Sequence[tuple[float, str]], top: str, missing: str) -> Column:
    """Bucket label: the first step with value < bound."""
    v = col(value)
    out = F.when(v.isNull(), missing)
    for bound, label in steps:
        out = out.when(v < bound, label)
    return out.otherwise(top)

"""Ordered windows that stay exact when one key holds a large share of all rows.

A plain ``partitionBy(key)`` window sends a whole key to one task. Here a key of many rows is cut along its order
into slices of about equal row counts: a mergeable quantile sketch per key gives the cuts, rows that tie stay together,
and exact counts of the slices follow. Per slice a small partial result is aggregated, prefixes run over the slice table
only, and the row-level work happens inside ``(key, slice)``, for bounded frames with the last rows of the slice before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kickframe.session import stored

#: Rows of a slice, about; keys with fewer rows stay whole.
SLICE_ROWS = 100_000
#: Cuts of a whole table at most: slices grow instead, so that the cuts, which go to every task, stay a few MB.
CUTS = 50_000
#: Cuts of one key at most.
RANKS = 1_024
#: Size of a key's quantile sketch; a slice is off by about 0.1% of its key's rows.
SKETCH = 8_192
START, NOW = W.unboundedPreceding, W.currentRow


def _same(keys: Sequence[str], other: Sequence[str]) -> Column:
    """Equal keys, null with null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other, strict=True)], F.lit(True))


def _place(cuts: str, at: str) -> Column:
    """Number of cuts below ``at`` by bisection; 0 without cuts and for null."""
    steps = F.array(*[F.lit(1 << b) for b in range(RANKS.bit_length(), -1, -1)])
    below = lambda got, step: (got + step <= F.size(cuts)) & (F.get(F.col(cuts), got + step - 1) < F.col(at))
    found = F.aggregate(steps, F.lit(0), lambda got, step: F.when(below(got, step), got + step).otherwise(got))
    return F.when(F.col(cuts).isNull() | F.col(at).isNull(), 0).otherwise(found)


def sliced(df: DataFrame, keys: Sequence[str], at: Column, rows: int | None = None, least: int = 1, store: bool = True) -> DataFrame:
    """``df`` with ``_slice`` (0, 1, ... along ``at``), ``_last`` (the key's last slice) and ``_off`` (rows of the key in earlier slices).

    ``at`` is a number that never falls along the order; equal values share a slice. Every slice but a key's first has at least
    ``least`` rows. Rows are counted first, which runs a job; only where a key has more than ``rows`` rows its cuts are looked for. The
    table of cuts has at most 2 x CUTS entries, whatever the table's size, and goes to all tasks. Without
    ``store`` a table that is cut is not written first but read anew for the cuts, keys and ``at`` only: right for wide rows of a plain scan.
    """
    keys, names = list(keys), [f"_k{i}" for i, _ in enumerate(keys)]
    by = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    whole = [F.lit(0).alias("_slice"), F.lit(0).alias("_last"), F.lit(0).cast("long").alias("_off")]
    sizes = lambda d: d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    seen = sizes(df).agg(F.max("_n").alias("top"), F.sum("_n").alias("total")).first()
    most = max(rows or SLICE_ROWS, least, -(-(seen["total"] or 0) // CUTS))
    if (seen["top"] or 0) <= most:
        return df.select("*", *whole)
    spark = df.sparkSession
    df = stored(df) if store else df  # the sketch, the counts, the slices and what callers aggregate per slice read it
    df = df.withColumn("_at", at.cast("double"))
    big = sizes(df).where(F.col("_n") > most).select(*names, F.least(F.ceil(F.col("_n") / most), F.lit(RANKS)).cast("int").alias("_m"))
    grid = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(i / RANKS) for i in range(1, RANKS)]))
    sketch = df.select(*keys, "_at").join(F.broadcast(big), _same(keys, names)).groupBy(*names, "_m").agg(F.kll_sketch_agg_double("_at", F.lit(SKETCH)).alias("_s")).withColumn("_q", grid)
    raw = sketch.select(*names, F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_m") - 1), lambda i: F.get("_q", F.floor(i * F.lit(RANKS) / F.col("_m")).cast("int") - 1))).alias("_raw"))
    raw = spark.createDataFrame(raw.collect(), raw.schema)  # at most 2 x CUTS numbers
    # exact counts of the big keys' slices; a thin slice joins the one before
    placed = df.select(*keys, "_at").join(F.broadcast(raw), _same(keys, names)).select(*names, _place("_raw", "_at").alias("_slice"), "_raw")
    counts = placed.groupBy(*names, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.first(F.get("_raw", F.col("_slice") - 1)).alias("_cut"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*names).orderBy("_slice").rowsBetween(START, -1)))
    kept = before.where((F.col("_slice") > 0) & (F.col("_n") >= least)).groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_cut", "_before"))).alias("_c"))
    kept = kept.select(*names, F.col("_c._cut").alias("_cuts"), F.col("_c._before").alias("_offs"))
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    out = df.join(F.broadcast(kept), _same(keys, names), "left").withColumn("_slice", _place("_cuts", "_at"))
    last, off = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts")), F.coalesce(F.get("_offs", F.col("_slice") - 1), F.lit(0))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != "_at"], "_slice", last.alias("_last"), off.alias("_off"))


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], at: Column, out: str = "rn", ties: bool = False, rows: int | None = None) -> DataFrame:
    """Exact 1-based row number per key (rank with ``ties``). ``at`` is a number that never falls along the order."""
    number = F.rank() if ties else F.row_number()
    local = number.over(W.partitionBy(*keys, "_slice").orderBy(*order))
    return sliced(df, keys, at, rows).withColumn(out, local + F.col("_off")).drop("_slice", "_last", "_off")


def haloed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], at: Column, reach: int, rows: int | None = None) -> DataFrame:
    """Slices with the last ``reach`` rows before them: ``_slice``, ``_off`` and ``_copy`` (1 for such a copy)."""
    cut = sliced(df, keys, at, rows, reach)
    back = [(F.col(c) if isinstance(c, str) else c).desc() for c in order]
    # a partial top-k ahead of the shuffle: only the ends of slices of big keys move twice
    tails = cut.where("_slice < _last").withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*back))).where(F.col("_r") <= reach).drop("_r")
    tails = tails.withColumns({"_slice": F.col("_slice") + 1, "_copy": F.lit(1)})
    return cut.withColumn("_copy", F.lit(0)).unionByName(tails).drop("_last")


def rows_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    frames: Mapping[str, tuple[int, int, Callable]],
    at: Column,
    rows: int | None = None,
    keep_ordinal: str | None = None,
) -> DataFrame:
    """Bounded ROWS frames, ``frames[name] = (lo, hi, agg)`` with lo <= hi <= 0; ``agg(frame, base)`` gets
    the framed window and the bare ordered window (for lag)."""
    reach = max(-min(lo for lo, _, _ in frames.values()), 1)
    spread = haloed(df, keys, order, at, reach, rows)
    base = W.partitionBy(*keys, "_slice").orderBy(*order)
    made = {n: agg(base.rowsBetween(lo, hi), base) for n, (lo, hi, agg) in frames.items()}
    if keep_ordinal:
        made[keep_ordinal] = F.sum(1 - F.col("_copy")).over(base.rowsBetween(START, NOW)) + F.coalesce(F.max(F.when(F.col("_copy") == 0, F.col("_off"))).over(W.partitionBy(*keys, "_slice")), F.lit(0))
    return spread.select("*", *[c.alias(n) for n, c in made.items()]).filter("_copy = 0").select(*df.columns, *made)


def _with_prefix(cut: DataFrame, keys: Sequence[str], closing: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """``cut`` with prefixes over the slices before. ``closing`` has one row per slice of the big keys, at most 2 x CUTS."""
    names = [f"_k{i}" for i, _ in enumerate(keys)]
    table = closing.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_slice").alias("_ks"), *[c.alias(n) for n, c in cols.items()])
    return cut.join(F.broadcast(table), _same([*keys, "_slice"], [*names, "_ks"]), "left").drop(*names, "_ks")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    at: Column,
    maxes: Mapping[str, Column] | None = None,
    inclusive: bool = False,
    strict_on: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Unbounded running sums (0 on an empty frame) and maxima (null on an empty frame).

    ``strict_on`` (a number) makes the frame all rows with a strictly smaller value, ties excluded; it must
    be the leading order expression, and the same as ``at``.
    """
    maxes = dict(maxes or {})
    cut = sliced(df, keys, at, rows)
    parts = {f"_p_{n}": F.sum(c) for n, c in sums.items()} | {f"_p_{n}": F.max(c) for n, c in maxes.items()}
    per_slice = cut.where("_last > 0").groupBy(*keys, "_slice").agg(*[c.alias(n) for n, c in parts.items()])
    per_key = W.partitionBy(*keys).orderBy("_slice").rowsBetween(START, -1)
    prefix = {f"_p_{n}": F.sum(f"_p_{n}").over(per_key) for n in sums} | {f"_p_{n}": F.max(f"_p_{n}").over(per_key) for n in maxes}
    if strict_on is not None:
        local = W.partitionBy(*keys, "_slice").orderBy(strict_on).rangeBetween(START, -1)
    else:
        local = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(START, 0 if inclusive else -1)
    zero = F.lit(0)
    staged = cut.select(
        "*",
        *[F.sum(c).over(local).alias(f"_l_{n}") for n, c in sums.items()],
        *[F.max(c).over(local).alias(f"_l_{n}") for n, c in maxes.items()],
    )
    return _with_prefix(staged, keys, per_slice, prefix).select(
        *df.columns,
        *[(F.coalesce(f"_p_{n}", zero) + F.coalesce(f"_l_{n}", zero)).alias(n) for n in sums],
        *[F.greatest(f"_p_{n}", f"_l_{n}").alias(n) for n in maxes],
    )


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    values: Mapping[str, Column],
    at: Column,
    rank: Column,
    inclusive: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Last non-null value of each column on the rows before (or up to) the current one.

    ``rank`` is a sortable struct equal to the order, used to take the last value of a whole slice.
    """
    cut = sliced(df, keys, at, rows)
    closing = cut.where("_last > 0").groupBy(*keys, "_slice").agg(*[F.max_by(c, F.when(c.isNotNull(), rank)).alias(f"_c_{n}") for n, c in values.items()])
    per_key = W.partitionBy(*keys).orderBy("_slice").rowsBetween(START, -1)
    local = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(START, 0 if inclusive else -1)
    staged = cut.select("*", *[F.last(c, ignorenulls=True).over(local).alias(f"_l_{n}") for n, c in values.items()])
    earlier = {f"_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(per_key) for n in values}
    return _with_prefix(staged, keys, closing, earlier).select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])


def first_of_ties(df: DataFrame, keys: Sequence[str], ts: str, rank: Column, cols: Sequence[str]) -> DataFrame:
    """Give all rows of one (key, ts) the values of the first of them under ``rank``."""
    firsts = df.groupBy(*keys, ts).agg(F.min_by(F.struct(*cols), rank).alias("_first"))
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept).join(firsts, [*keys, ts]).select(*kept, *[F.col(f"_first.{c}").alias(c) for c in cols])


def ewma(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    values: Mapping[str, Column],
    at: Column,
    half_life: float,
    priors: Mapping[str, float] | None = None,
    before: bool = False,
) -> DataFrame:
    """Exponentially weighted mean over rows, seeded by the first value or by a fixed prior.

    The recursion ``e = (1-a) e + a x`` unrolls to powers of ``q = 1-a`` inside a block of rows; a block is
    long enough that the weight of anything before the previous block is below double precision, so two
    closing values carry the state over. ``before`` gives the state ahead of the current row.
    """
    q = 0.5 ** (1.0 / max(half_life, 1.0))
    a = 1.0 - q
    size = max(64, int(math.ceil(30.0 / -math.log(q))))
    priors = priors or {}
    numbered = ordinal(df, keys, order, at, "_rn")
    numbered = numbered.withColumns(
        {"_block": F.floor((F.col("_rn") - 1) / F.lit(size)), "_i": F.pmod(F.col("_rn") - 1, F.lit(size)) + 1}
    )
    first = F.col("_rn") == 1
    up, down = F.pow(F.lit(q), -F.col("_i")), F.pow(F.lit(q), F.col("_i"))
    w = W.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(START, NOW)

    def term(name: str, x: Column) -> Column:
        if name in priors:
            return F.lit(a) * x * up + F.when(first, F.lit(float(priors[name]))).otherwise(F.lit(0.0))
        return F.when(first, x * up).otherwise(F.lit(a) * x * up)

    local = numbered.select("*", *[(F.sum(term(n, x)).over(w) * down).alias(f"_e_{n}") for n, x in values.items()])
    closing = local.filter(F.col("_i") == size).select(*keys, (F.col("_block") + 1).alias("_block"), *[F.col(f"_e_{n}").alias(f"_c1_{n}") for n in values])
    older = closing.select(
        *keys, (F.col("_block") + 1).alias("_block"), *[F.col(f"_c1_{n}").alias(f"_c2_{n}") for n in values]
    )
    carry = closing.join(older, [*keys, "_block"], "left")
    tail = F.lit(q**size)
    joined = local.join(carry, [*keys, "_block"], "left")
    states = {
        n: F.col(f"_e_{n}")
        + down * (F.coalesce(f"_c1_{n}", F.lit(0.0)) + tail * F.coalesce(f"_c2_{n}", F.lit(0.0)))
        for n in values
    }
    if before:
        states = {n: (s - F.lit(a) * values[n]) / F.lit(q) for n, s in states.items()}
        if set(values) - set(priors):
            raise ValueError("state before a row needs a prior for every value")
    return joined.select(*df.columns, *[s.alias(n) for n, s in states.items()])

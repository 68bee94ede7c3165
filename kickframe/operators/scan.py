"""Affine scans: states that each row moves by ``e -> keep * e + add``, in order, per key.

Such maps compose to one of their kind, so a slice of rows comes down to one map, openings of slices follow from the maps of
the slices before, and inside a slice the maps compose in log steps. Rows that leave a state alone are the map 1 * e + 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickframe.operators.ordered import _same, sliced


def compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the map of all rows up to it; ``a`` and ``b`` are rows x states."""
    a, b, d = a.copy(), b.copy(), 1
    while d < len(a):
        b[d:] = a[d:] * b[:-d] + b[d:]
        a[d:] = a[d:] * a[:-d]
        d *= 2
    return a, b


def affine_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, states: Mapping[str, tuple[Column, Column, Column | float]], rows: int | None = None) -> DataFrame:
    """Each row with its states before the row's own step; ``states[name] = (keep, add, start)``.

    ``start`` is the state ahead of a key's first row and the same for all rows of the key; a null ``keep`` or ``add`` leaves the
    state as it is. ``order`` is a total order whose leading number is ``at``. No key meets in one task: see ``sliced``.
    """
    keys, names, m = list(keys), list(states), len(states)
    cut = sliced(df, keys, at, rows)
    known = {n: k.isNotNull() & a.isNotNull() for n, (k, a, _) in states.items()}
    made = [F.when(known[n], k.cast("double")).otherwise(1.0).alias(f"_a{i}") for i, (n, (k, _, _)) in enumerate(states.items())]
    made += [F.when(known[n], a.cast("double")).otherwise(0.0).alias(f"_b{i}") for i, (n, (_, a, _)) in enumerate(states.items())]
    made += [(s if isinstance(s, Column) else F.lit(float(s))).cast("double").alias(f"_o{i}") for i, (_, _, s) in enumerate(states.values())]
    steps = cut.select("*", *made)
    ab = [f"_{c}{i}" for c in "ab" for i in range(m)]
    opens = [f"_o{i}" for i in range(m)]
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)

    def closing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One map per slice. Its rows arrive in order; the first one is marked."""
        held, at_key = None, None
        for pdf in frames:
            x = pdf[ab].to_numpy()
            first = np.flatnonzero(pdf["_first"].to_numpy())
            for lo, hi in zip([0, *first.tolist()], [*first.tolist(), len(pdf)], strict=True):
                if lo in first and held is not None:
                    yield pd.DataFrame([[*at_key, *held]], columns=[*kept, *ab])
                    held = None
                if hi > lo:
                    a, b = (y[-1] for y in compose(x[lo:hi, :m], x[lo:hi, m:]))
                    held = np.concatenate([a, b] if held is None else [a * held[:m], a * held[m:] + b])
                    at_key = pdf[kept].iloc[lo].tolist()
        if held is not None:
            yield pd.DataFrame([[*at_key, *held]], columns=[*kept, *ab])

    # slices of the big keys: at most 2 x CUTS maps, and their openings
    kept = [f"_k{i}" for i, _ in enumerate(keys)] + ["_ks", *opens]
    typed = [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)] + [T.StructField("_ks", T.IntegerType())]
    typed += [T.StructField(o, T.DoubleType()) for o in opens]
    large = steps.where("_last > 0").withColumn("_first", F.row_number().over(inside) == 1)
    maps = large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_ks"), *opens, *ab, "_first")
    maps = maps.mapInPandas(closing, T.StructType([*typed, *[T.StructField(c, T.DoubleType()) for c in ab]]))

    def openings(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ks")
        x, state, out = pdf[ab].to_numpy(), pdf[opens].to_numpy()[0], []
        for row in x:
            out.append(state)
            state = row[:m] * state + row[m:]
        pdf[opens] = np.array(out)
        return pdf[kept]

    told = maps.groupBy(*kept[: len(keys)]).applyInPandas(openings, T.StructType(typed))
    told = told.withColumnsRenamed({o: f"_w{o}" for o in opens})
    if "_last" in cut.columns and not large.isEmpty():
        steps = steps.join(F.broadcast(told), _same([*keys, "_slice"], kept[: len(keys) + 1]), "left").withColumns({o: F.coalesce(f"_w{o}", o) for o in opens})
    sent = steps.withColumn("_first", F.row_number().over(inside) == 1).select(*[F.col(f"`{c}`") for c in df.columns], *ab, *opens, "_first")
    columns = list(df.columns)
    n = len(columns)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros(m)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n, n + 3 * m)])
            a, b, o = x[:, :m], x[:, m : 2 * m], x[:, 2 * m :]
            first = batch.column(n + 3 * m).to_numpy(zero_copy_only=False)
            o = np.where(first[:, None], o, 0.0)
            if not first[0]:
                o[0] = carry
            begin = first.copy()
            begin[0] = True
            _, after = compose(np.where(begin[:, None], 0.0, a), np.where(begin[:, None], a * o + b, b))
            before = np.where(begin[:, None], o, np.vstack([carry[None, :], after[:-1]]))
            carry = after[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(before[:, i]) for i in range(m))], [*columns, *names])

    return sent.mapInArrow(walk, T.StructType([*df.schema.fields, *[T.StructField(x, T.DoubleType()) for x in names]]))

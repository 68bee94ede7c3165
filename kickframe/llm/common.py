"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickframe.session import cut_lineage

#: Code points that one step of a Python worker handles at once; a longer text is one step of its own.
STEP_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Row-wise work on Arrow batches; ids stay Arrow arrays, so that nulls and 64-bit values keep their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], *added: T.StructField) -> DataFrame:
    """Whole rows through ``fn``, which may drop rows and append the ``added`` columns; columns may have any names."""
    plain = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    named = df.toDF(*(f.name for f in plain))
    extra = [T.StructField(f"x{i}", f.dataType) for i, f in enumerate(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield pa.RecordBatch.from_arrays(out.columns, [*batch.schema.names, *(f.name for f in extra)])

    return named.mapInArrow(run, T.StructType([*plain, *extra])).toDF(*df.columns, *(f.name for f in added))


def steps(lengths: list[int], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into runs of at most ``most`` units, one row at least."""
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield at, len(lengths)


def settle(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder: later passes read it, and lost executors cost no recomputation."""
    return cut_lineage(df)

"""Query registry: name -> (Spark callable, oracle SQL or none)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickframe.plans.fixtures import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a builder. ``covers`` lists the inventory ids it exercises."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), fn, nudge_rounds(sql) if sql else None)
        return fn

    return register


NUDGE = 1e-9


def nudge_rounds(text: str) -> str:
    """Put the tie-breaking nudge inside every ``ROUND(x, 6)``, so that float noise cannot flip a half."""
    out, at = [], 0
    stack: list[bool] = []
    while at < len(text):
        if text.startswith("ROUND(", at):
            out.append("ROUND(")
            stack.append(True)
            at += 6
        elif text[at] == "(":
            out.append("(")
            stack.append(False)
            at += 1
        elif text[at] == ")":
            rounding = stack.pop()
            if rounding:
                body = "".join(out)
                cut = body.rindex(", 6")
                out = [body[:cut], " + 1e-9, 6"]
            out.append(")")
            at += 1
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def settle_types(df: DataFrame) -> DataFrame:
    """Comparable output: integers as bigint, decimals as double, doubles rounded to 6 places without -0.0."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def spark_callable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return settle_types(q.build(Tables(spark, sf_dir)))

    run.__name__ = q.name
    return run

"""Connected components by alternating large-star and small-star rounds, in joins and minimum aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm.common import settle


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. ``large``: every larger neighbour is hung on the node's minimum; else the node and its smaller ones."""
    if large:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = near.join(low, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; ``root`` is the smallest node reachable.

    ``edges`` has two non-null columns u, v of one ordered type. A hub is never gathered: its neighbours meet in a
    minimum aggregate with map-side combine and a join that adaptive execution may split. No edges: no rows. Rounds go on until
    the links stop changing.
    """
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = settle(_star(_star(edges, True), False))
        was, mark = mark, _mark(edges)
        if was == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn one below the other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.llm.common import col, settle, table

#: Rows of one shard that are numbered together.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, base: int = 16, per_rack: int = 2, per_region: int = 4) -> list[Shard]:
    """The first ``base`` shards fill racks and regions; every later one opens a region of its own.

    A new region leaves the weights in all others as they were, so that growth by one moves rows only into the new shard.
    """
    return [Shard(f"r{i // per_region}", f"k{i // per_rack}", i) if i < base else Shard(f"x{i}", f"x{i}", i) for i in range(shards)]


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw of rate ``weight``: the least of such draws falls on a node in proportion to its weight."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(unit) / weight


def _descend(key: Column, path: str, nodes: dict) -> Column:
    """The leaf under the winning node; ties go to the smaller node name."""
    live = {n: below for n, below in nodes.items() if _weight(below) > 0}
    if len(live) == 1:
        ((name, below),) = live.items()
        return _leaf(key, f"{path}/{name}", below)
    drawn = F.array_min(F.array(*(F.struct(_draw(key, f"{path}/{n}", _weight(live[n])).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(sorted(live)))))
    out = None
    for i, n in enumerate(sorted(live)):
        leaf = _leaf(key, f"{path}/{n}", live[n])
        out = F.when(drawn["i"] == i, leaf) if out is None else out.when(drawn["i"] == i, leaf)
    return out


def _leaf(key: Column, path: str, below) -> Column:
    return F.lit(below[0]) if isinstance(below, tuple) else _descend(key, path, below)


def _weight(below) -> float:
    return below[1] if isinstance(below, tuple) else sum(map(_weight, below.values()))


def place(key: Column, shards: list[Shard]) -> Column:
    """The shard of a key. A changed weight moves keys only into or out of the region, rack and shard that it belongs to.

    Shards of weight 0 get nothing. A null key is a key like any other.
    """
    nodes: dict = {}
    for s in shards:
        if s.weight < 0:
            raise ValueError("a weight is negative")
        nodes.setdefault(s.region, {}).setdefault(s.rack, {})[f"{s.shard:09d}"] = (s.shard, s.weight)
    if not shards or _weight(nodes) <= 0:
        raise ValueError("no shard has weight")
    return _descend(key, "", nodes)


def assign(df: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law ``key``: only the id decides.

    ``size`` is the UTF-8 length of the text plus 1, a null text counts as empty. Slots number the rows of a shard from 0
    without gaps: rows are counted per bucket of hashed ids, the buckets' counts are summed up, and rows are numbered
    inside their bucket only. Buckets grow in number with the rows. Repeated rows and equal texts get slots of their own;
    texts never move. Null ids form one key. An empty table gives no rows.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    key = col(id_col)
    rows = df.select(
        key.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), place(key, shards).alias("shard"),
        (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    buckets = max(1, -(-df.count() // slot_rows)) * 4
    # a repeated id is dealt by its text too, so that no id fills a bucket with different rows
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    rows = settle(rows)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    base = counts.select("shard", "bucket", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY bucket) - n").alias("base"))
    slots = rows.withColumn("at", F.expr("row_number() OVER (PARTITION BY shard, bucket ORDER BY doc_id, text_crc32, size)"))
    return slots.join(base, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), tree(16), tree(17))

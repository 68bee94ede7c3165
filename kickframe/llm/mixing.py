"""Mixing sources by temperature: shares to an exponent, the exponent bisected to a target, weights realised as block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.llm.common import col, settle, table

#: Blocks of one source: its rows are dealt to them by hashed id, and whole blocks are taken in permuted order.
BLOCKS = 1024
#: Rows of a block at most, about: larger tables have more blocks.
BLOCK_ROWS = 20_000
#: Parts that one job cuts the bracket of the exponent into.
GRID = 32
#: Source tables of at most so many rows are broadcast; larger ones are joined by shuffle.
SMALL = 10_000


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet.

    ``repetition``: most times that any source is read. ``entropy``: entropy of the weights as a share of its largest value,
    the logarithm of the number of sources. ``budget``: tokens of the mixture; None: as many as read the largest
    source once, so that no row is left out. With both targets the repetition limit goes first.
    """

    repetition: float | None = 2.0
    entropy: float | None = None
    budget: float | None = None


def tokens_of(text: Column) -> Column:
    """Words between white space; at least 1, so that empty and null texts have a place in the budget."""
    return F.greatest(F.size(F.split(F.trim(F.coalesce(text.cast("string"), F.lit(""))), r"\s+")), F.lit(1)).cast("long")


def _measure(sources: DataFrame, first, target: Target, exponents: list[float]) -> list[tuple[float, float]]:
    """(largest repetition, share of the largest entropy) at each exponent, from one aggregate over the source table."""
    logp = F.log(F.col("tokens") / F.lit(float(first["t"])))
    row = sources.agg(*(F.struct(F.sum(F.exp(logp * a)).alias("z"), F.sum(F.exp(logp * a) * logp * a).alias("e")).alias(f"a{k}") for k, a in enumerate(exponents))).first()
    low, high, out = math.log(first["lo"] / first["t"]), math.log(first["hi"] / first["t"]), []
    for k, a in enumerate(exponents):
        z, e = row[k]["z"], row[k]["e"]
        epochs = math.exp((1 - a) * (high - low)) if target.budget is None else target.budget / first["t"] * math.exp((a - 1) * low) / z
        out.append((epochs, (math.log(z) - e / z) / math.log(first["n"])))
    return out


def exponent(sources: DataFrame, target: Target) -> float:
    """The exponent a in 0..1 of the weights p^a / sum(p^a).

    Repetition and entropy both fall as a grows: for a limit the smallest a that keeps it is bracketed, for an entropy the
    largest that reaches it. A job measures a grid of exponents at once; eight narrow the bracket below 1e-12, and the
    source table never comes to the driver. A limit that even a = 1 breaks gives 1. One source or none, or equal ones: 1.
    """
    first = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi")).first()
    if first["n"] < 2 or first["lo"] == first["hi"]:
        return 1.0

    def bracket(low: float, meets, rising: bool) -> float:
        high = 1.0
        for _ in range(8):
            grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
            ok = [meets(m) for m in _measure(sources, first, target, grid)]
            if rising:  # false .. true: the first that meets it
                k = ok.index(True) if True in ok else GRID
                low, high = grid[max(k - 1, 0)], grid[k]
            else:  # true .. false: the last that meets it
                k = max((i for i, x in enumerate(ok) if x), default=0)
                low, high = grid[k], grid[min(k + 1, GRID)]
        return high if rising else low

    limit = 0.0 if target.repetition is None else bracket(0.0, lambda m: m[0] <= target.repetition, True)
    if target.entropy is None:
        return limit if target.repetition is not None else 1.0
    return max(limit, bracket(limit, lambda m: m[1] >= target.entropy, False))


def plan(rows: DataFrame, target: Target, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """(source, weight, epochs, cut_block, cut_row) per source; ``rows`` has id, source, tokens.

    The budget of a source is its weight times all tokens: ``epochs`` whole readings and a rest. For the rest blocks are
    taken in the permuted order of that epoch until one would pass it; inside that block rows are taken in hash order. So a
    row belongs to the last epoch exactly if its (block hash, row hash) is at most (cut_block, cut_row).
    """
    per = settle(rows.withColumn("b", block_of(F.col("id"), blocks, seed)).groupBy("source", "b").agg(F.sum("tokens").alias("tokens")))
    sources = per.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    a = exponent(sources, target)
    z = sources.agg(F.sum(F.pow(F.col("tokens").cast("double"), a)).alias("z"), F.max("tokens").alias("hi")).first()
    if z["hi"] is None:
        return sources.select("source", *(F.lit(None).cast(t).alias(n) for n, t in (("weight", "double"), ("epochs", "long"), ("cut_block", "long"), ("cut_row", "long"))))
    weight = F.pow(F.col("tokens").cast("double"), a) / F.lit(z["z"])
    budget = float(target.budget) if target.budget is not None else z["hi"] / (z["hi"] ** a / z["z"])
    whole = sources.select("source", "tokens", weight.alias("weight"), (weight * budget).alias("due"))
    whole = whole.withColumn("epochs", F.floor(F.col("due") / F.col("tokens") + 1e-9)).withColumn("rest", F.floor(F.greatest(F.lit(0.0), F.col("due") - F.col("epochs") * F.col("tokens"))))
    near = F.col("s.source").eqNullSafe(F.col("p.source"))
    order = per.alias("p").join(whole.alias("s"), near).select("s.source", "p.b", "p.tokens", "epochs", "rest")
    order = order.withColumn("h", block_hash(F.col("source"), F.col("b"), F.col("epochs"), seed))
    order = order.withColumn("base", F.expr("sum(tokens) OVER (PARTITION BY source ORDER BY h) - tokens"))
    # the first block that passes the rest; its rows are dealt with one by one
    met = order.where("base <= rest AND base + tokens > rest").groupBy("source").agg(F.min_by("b", "h").alias("b"), F.min("h").alias("cut_block"), F.min_by("base", "h").alias("base"))
    sides = whole.alias("s").join(met.alias("p"), near, "left").select("s.source", "weight", "epochs", "rest", "p.b", "p.cut_block", "p.base")
    sides = small(settle(sides))
    inside = rows.withColumn("b", block_of(F.col("id"), blocks, seed)).alias("p").join(sides.alias("s"), near & (F.col("p.b") == F.col("s.b")))
    inside = inside.select("s.source", "tokens", "rest", "base", row_hash(F.col("id"), F.col("epochs"), seed).alias("h"))
    inside = inside.withColumn("upto", F.expr("base + sum(tokens) OVER (PARTITION BY source ORDER BY h)"))
    rowcut = inside.where("upto <= rest").groupBy("source").agg(F.max("h").alias("cut_row"))
    out = sides.alias("s").join(rowcut.alias("p"), near, "left")
    lowest = F.lit(-(1 << 63)).cast("long")
    return settle(out.select("s.source", "weight", "epochs", F.coalesce("cut_block", lowest).alias("cut_block"), F.coalesce("cut_row", lowest).alias("cut_row")))


def block_of(key: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(f"block{seed}")), F.lit(blocks)).cast("int")


def block_hash(source: Column, block: Column, epoch: Column, seed: int) -> Column:
    """Place of a block in the permutation of an epoch."""
    return F.xxhash64(source, block, epoch.cast("long"), F.lit(seed))


def row_hash(key: Column, epoch: Column, seed: int) -> Column:
    """Place of a row inside its block in an epoch; the lowest value is left to mark "none"."""
    return F.greatest(F.xxhash64(key, epoch.cast("long"), F.lit(f"row{seed}")), F.lit(-(1 << 63) + 1).cast("long"))


def small(df: DataFrame) -> DataFrame:
    """Broadcast behind a count; larger tables are left to the optimiser's shuffle joins."""
    return F.broadcast(df) if df.count() <= SMALL else df


def mixed(df: DataFrame, target: Target = Target(), seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """Rows of ``df`` once per reading, with __kf_weight, __kf_epoch, __kf_block_at and __kf_row_at behind its columns.

    Sorting by the last three gives the stream: epochs, in each the blocks permuted anew, in each block the rows permuted.
    A source has BLOCKS blocks, or one for each BLOCK_ROWS rows of the table if these are more.
    Null sources form one source; null and empty texts count one token; null ids and repeated ids share one place each, so
    that their rows are taken together; an empty table stays empty.
    """
    id_, source = col(id_col), col(source_col)
    rows = settle(df.select(id_.alias("id"), source.alias("source"), tokens_of(col(text_col)).alias("tokens")))
    blocks = blocks or max(BLOCKS, -(-rows.count() // BLOCK_ROWS))
    cuts = plan(rows, target, seed, blocks).withColumnsRenamed({n: f"__kf_{n}" for n in ("source", "weight", "epochs", "cut_block", "cut_row")})
    out = df.join(small(cuts), source.eqNullSafe(F.col("__kf_source")))
    block = block_of(id_, blocks, seed)
    last = F.struct(block_hash(source, block, F.col("__kf_epochs"), seed).alias("b"), row_hash(id_, F.col("__kf_epochs"), seed).alias("r"))
    # up to the cut: an earlier block, or the cut block and a row hash up to the cut
    taken = (last["b"] < F.col("__kf_cut_block")) | ((last["b"] == F.col("__kf_cut_block")) & (last["r"] <= F.col("__kf_cut_row")))
    copies = F.col("__kf_epochs") + taken.cast("long")
    out = out.withColumn("__kf_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1))))
    return out.select(
        *(col(c) for c in df.columns), "__kf_weight", "__kf_epoch",
        block_hash(source, block, F.col("__kf_epoch"), seed).alias("__kf_block_at"), row_hash(id_, F.col("__kf_epoch"), seed).alias("__kf_row_at"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """One row per reading of a document in the mixture, with its place in the stream."""
    docs = table(spark, sf_dir, "documents")
    out = mixed(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", tokens_of(F.col("text")).alias("tokens"), F.round("__kf_weight", 12).alias("weight"), F.col("__kf_epoch").alias("epoch"), F.col("__kf_block_at").alias("block_at"), F.col("__kf_row_at").alias("row_at"))

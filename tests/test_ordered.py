"""Ordered windows cut into slices and blocks must equal plain windows and plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kickframe.functions.cols import unix
from kickframe.operators import ordered as od
from kickframe.operators.quantiles import grouped_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(400):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(6)}"
        ts = 1_000_000_000 + rnd.randrange(300) * 86400
        data.append((i, key, ts, None if rnd.random() < 0.1 else float(rnd.randrange(50))))
    df = spark.createDataFrame(data, "id long, key string, t long, v double")
    return df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).cache()


def same(a, b, cols):
    x = {r["id"]: [r[c] for c in cols] for r in a.collect()}
    y = {r["id"]: [r[c] for c in cols] for r in b.collect()}
    assert x.keys() == y.keys()
    for k in x:
        for p, q in zip(x[k], y[k]):
            assert (p is None) == (q is None) and (p is None or abs(p - q) < 1e-9), (k, x[k], y[k])


def test_ordinal_and_bounded_frames(rows):
    order = ["ts", "id"]
    frames = {"m": (-10, -1, lambda w, b: F.avg("v").over(w)), "n": (-9, 0, lambda w, b: F.count("v").over(w)), "l": (-3, 0, lambda w, b: F.lag("v", 3).over(b))}
    got = od.rows_frame(rows, ["key"], order, frames, unix("ts"), rows=16, keep_ordinal="rn")
    w = W.partitionBy("key").orderBy(*order)
    want = rows.select("id", F.avg("v").over(w.rowsBetween(-10, -1)).alias("m"), F.count("v").over(w.rowsBetween(-9, 0)).alias("n"), F.lag("v", 3).over(w).alias("l"), F.row_number().over(w).alias("rn"))
    same(got, want, ["m", "n", "l", "rn"])


@pytest.mark.parametrize("strict", [False, True])
def test_running_sums_and_maxima(rows, strict):
    order = ["ts", "id"]
    on = unix("ts") if strict else None
    got = od.running(rows, ["key"], order, {"s": F.coalesce("v", F.lit(0.0))}, unix("ts"), maxes={"m": F.col("v")}, strict_on=on, rows=20)
    w = W.partitionBy("key").orderBy(unix("ts")).rangeBetween(W.unboundedPreceding, -1) if strict else W.partitionBy("key").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    want = rows.select("id", F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("s"), F.max("v").over(w).alias("m"))
    same(got, want, ["s", "m"])


def test_last_before(rows):
    got = od.last_before(rows, ["key"], ["ts", "id"], {"p": F.col("v")}, unix("ts"), F.struct("ts", "id"), rows=20)
    w = W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, -1)
    same(got, rows.select("id", F.last("v", ignorenulls=True).over(w).alias("p")), ["p"])


@pytest.mark.parametrize("half_life", [1.0, 3.0, 20.0])
def test_ewma_over_many_blocks(rows, half_life):
    x = F.coalesce("v", F.lit(0.0))
    seeded = od.ewma(rows, ["key"], ["ts", "id"], {"e": x}, unix("ts"), half_life).collect()
    before = od.ewma(rows, ["key"], ["ts", "id"], {"e": x}, unix("ts"), half_life, priors={"e": 7.0}, before=True)
    before = {r["id"]: r["e"] for r in before.collect()}
    a = 1 - 0.5 ** (1 / half_life)
    for key in {r["key"] for r in seeded}:
        mine = sorted((r for r in seeded if r["key"] == key), key=lambda r: (r["t"], r["id"]))
        e, p = None, 7.0
        for r in mine:
            v = r["v"] or 0.0
            e = v if e is None else (1 - a) * e + a * v
            assert abs(r["e"] - e) < 1e-9
            assert abs(before[r["id"]] - p) < 1e-8
            p = (1 - a) * p + a * v


def test_quantiles_match_the_sorted_list(rows):
    got = grouped_quantiles(rows, ["key"], "v", {"a": 0.1, "b": 0.5, "c": 0.93})
    want = rows.groupBy("key").agg(F.percentile("v", 0.1).alias("a"), F.percentile("v", 0.5).alias("b"), F.percentile("v", 0.93).alias("c"))
    x, y = {r["key"]: r for r in got.collect()}, {r["key"]: r for r in want.collect()}
    assert x.keys() == y.keys()
    for k in x:
        assert all(abs(x[k][c] - y[k][c]) < 1e-9 for c in "abc")


def test_slices_are_bounded_under_skew(spark):
    """Nine rows of ten in one key and one month: slices still hold about the asked number of rows, ties stay together."""
    i = F.col("id")
    hot = i % 10 != 0
    t = F.when(hot, F.lit(1_000_000_000) + i * 7919 % (30 * 86400)).otherwise(F.lit(1_000_000_000) + i * 86400)
    df = spark.range(200_000).select("id", F.when(hot, "hot").when(i % 20 == 0, F.lit(None)).otherwise("cold").alias("key"), t.alias("t"), (i % 50).cast("double").alias("v"))
    cut = od.sliced(df, ["key"], F.col("t"), rows=5_000, least=100)
    sizes = {(r["key"], r["_slice"]): r for r in cut.groupBy("key", "_slice").agg(F.count("*").alias("n"), F.min("_off").alias("off"), F.max("_off").alias("off2")).collect()}
    assert sum(r["n"] for r in sizes.values()) == 200_000
    assert max(r["n"] for r in sizes.values()) < 12_000 and min(r["n"] for (k, s), r in sizes.items() if s) >= 100
    assert len([k for k in sizes if k[0] == "hot"]) > 20
    for (key, s), r in sizes.items():
        assert r["off"] == r["off2"] == sum(x["n"] for (k, q), x in sizes.items() if k == key and q < s)
    assert cut.groupBy("key", "t").agg(F.countDistinct("_slice").alias("n")).where("n > 1").count() == 0
    frames = {"m": (-90, -1, lambda w, b: F.sum("v").over(w))}
    got = od.rows_frame(df, ["key"], ["t", "id"], frames, F.col("t"), rows=5_000, keep_ordinal="rn")
    w = W.partitionBy("key").orderBy("t", "id")
    want = df.select("id", F.sum("v").over(w.rowsBetween(-90, -1)).alias("wm"), F.row_number().over(w).alias("wrn"))
    off = got.join(want, "id").where("NOT (m <=> wm) OR rn <> wrn")
    assert got.count() == 200_000 and off.count() == 0


def test_thin_slices_still_have_whole_frames(spark):
    """Many rows at one moment leave thin slices behind; frames reach over them."""
    rows = [(i, "k", 5 if i < 300 else i // 2, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key string, t long, v double")
    got = od.rows_frame(df, ["key"], ["t", "id"], {"m": (-30, 0, lambda w, b: F.sum("v").over(w))}, F.col("t"), rows=10)
    for r in got.collect():
        assert r["m"] == sum(float(x) for x in range(max(0, r["id"] - 30), r["id"] + 1))

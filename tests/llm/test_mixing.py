from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kickframe.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "big" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


def shares(docs):
    rows = docs.select("source", mixing.tokens_of(F.col("text")).alias("t")).groupBy("source").agg(F.sum("t").alias("t")).collect()
    return {r["source"]: r["t"] for r in rows}


def entropy(weights):
    z = sum(weights)
    return -sum(w / z * math.log(w / z) for w in weights) / math.log(len(weights))


@pytest.mark.parametrize("limit", [1.0, 1.5, 4.0])
def test_repetition_limit(spark, docs, limit):
    t = shares(docs)
    sources = spark.createDataFrame(list(t.items()), "source string, tokens long")
    a = mixing.exponent(sources, mixing.Target(repetition=limit))
    assert math.isclose((max(t.values()) / min(t.values())) ** (1 - a), limit, rel_tol=1e-9) or a == 0.0


@pytest.mark.parametrize("target", [0.95, 0.99, 1.0])
def test_entropy(spark, docs, target):
    t = shares(docs)
    sources = spark.createDataFrame(list(t.items()), "source string, tokens long")
    a = mixing.exponent(sources, mixing.Target(repetition=None, entropy=target))
    assert math.isclose(entropy([x**a for x in t.values()]), max(target, entropy(list(t.values()))), abs_tol=1e-9)


@pytest.mark.parametrize("budget", [None, 20_000.0, 200_000.0])
def test_budgets_are_met_and_blocks_are_whole(docs, budget):
    out = mixing.mixed(docs, mixing.Target(budget=budget, repetition=2.0 if budget is None else None, entropy=None if budget is None else 0.99), blocks=8)
    rows = out.withColumn("t", mixing.tokens_of(F.col("text"))).collect()
    t, weight = shares(docs), {r["source"]: r["__kf_weight"] for r in rows}
    assert abs(sum(weight.values()) - 1) < 1e-9
    total = budget or max(t.values()) / weight["big"]
    per, seen = Counter(), Counter()
    for r in rows:
        per[r["source"]] += r["t"]
        seen[r["doc_id"]] += 1
    longest = 40
    for s in t:
        assert total * weight[s] - longest - 1 <= per[s] <= total * weight[s] + 1
    copies = {}
    for r in rows:
        copies.setdefault(r["source"], set()).add(seen[r["doc_id"]])
    assert all(max(c) - min(c) <= 1 for c in copies.values())
    if budget is None:
        assert set(seen) == {r["doc_id"] for r in docs.collect()}
    # in the last epoch all blocks but one are whole or absent
    for s in t:
        ids = [r["doc_id"] for r in docs.where(F.col("source") == s).collect()]
        block = {r["id"]: r["b"] for r in docs.where(F.col("source") == s).select(F.col("doc_id").alias("id"), mixing.block_of(F.col("doc_id"), 8, 7).alias("b")).collect()}
        top = max(seen[i] for i in ids)
        split = {b for b in set(block.values()) if len({seen[i] for i in ids if block[i] == b}) > 1}
        assert len(split) <= 1, (s, top)


def test_odd_rows(spark, odd_docs):
    out = mixing.mixed(odd_docs, mixing.Target(repetition=3.0))
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns
    have = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert set(have) == {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert mixing.mixed(odd_docs.limit(0)).count() == 0
    assert mixing.mixed(odd_docs.where("source = 's0'")).count() == odd_docs.where("source = 's0'").count()


def test_blocks_grow_with_the_table(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", max(1, docs.count() // 16))
    same = lambda df: sorted(map(str, df.collect()))
    assert same(mixing.mixed(docs)) == same(mixing.mixed(docs, blocks=-(-docs.count() // mixing.BLOCK_ROWS)))
    assert same(mixing.mixed(docs)) != same(mixing.mixed(docs, blocks=4))

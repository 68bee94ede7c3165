from __future__ import annotations

import zlib
from dataclasses import replace

from pyspark.sql import functions as F

from kickframe.llm import sharding


def test_contract(spark, odd_docs):
    got = sharding.assign(odd_docs, sharding.tree(16), sharding.tree(17)).collect()
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert len(got) == odd_docs.count()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts}
    by = {}
    for r in got:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign(odd_docs.limit(0), sharding.tree(16)).count() == 0


def test_balance_and_slots_over_buckets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.assign(docs, sharding.tree(16), sharding.tree(17), slot_rows=500)
    rows = got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()
    assert sorted(r["shard"] for r in rows) == list(range(16))
    for r in rows:
        assert (r["lo"], r["hi"], r["d"]) == (0, r["n"] - 1, r["n"]) and abs(r["n"] - 1250) < 200
    assert abs(got.where("grown_shard = 16").count() - 20_000 / 17) < 200


def test_weights_share_rows_and_confine_movement(spark):
    ids = spark.range(30_000)
    tree = sharding.tree(16)
    heavy = [replace(s, weight=3.0) if s.shard == 5 else s for s in tree]
    empty = [replace(s, weight=0.0) if s.shard == 5 else s for s in tree]
    rows = ids.select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavy).alias("b"), sharding.place(F.col("id"), empty).alias("c"))
    at = {s.shard: s for s in tree}
    assert abs(rows.where("b = 5").count() / 30_000 - 3 / 18) < 0.01 and rows.where("c = 5").count() == 0
    for r in rows.where("a <> b").distinct().collect():
        # whatever moves goes into the subtrees whose weight grew: the region, in it the rack, in it the shard
        old, new = at[r["a"]], at[r["b"]]
        assert new.region == at[5].region
        if old.region == new.region:
            assert new.rack == at[5].rack
            if old.rack == new.rack:
                assert new.shard == 5

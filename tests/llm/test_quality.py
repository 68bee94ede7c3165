from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from kickframe.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return quality.query(spark, SF).join(labels, "doc_id").toPandas()


def test_contract_and_held_out_accuracy(spark, scored):
    for r in scored.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = scored[scored.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.predicted == 1).mean() >= 0.97 and (bad.predicted == 0).mean() >= 0.7
    pairs = [(g > b) + 0.5 * (g == b) for g in good.score for b in bad.score]
    assert sum(pairs) / len(pairs) > 0.85  # some 45 bad texts to learn from at this size


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_odd_rows_and_missing_labels(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (99, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality.classify(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and {r["score"] for r in out} == {0.5}
    good = quality.Model(quality.dictionary(["the good text"] * 9), quality.dictionary(["*** bad !!!"] * 9), (60.0, 10.0), 5.0)
    rows = quality.score(odd_docs, good).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == odd_docs.count()
    assert len({r["score"] for r in rows if r["doc_id"] in (12, 13)}) == 1
    kept = quality.keep_good(odd_docs, good)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["score"] >= 0.3 for r in rows)
    assert quality.classify(odd_docs.limit(0), labels).count() == 0


def test_every_part_of_a_long_text_counts():
    packs = quality.packers(quality.dictionary(["plain words of the text " * 5] * 9), quality.dictionary(["### $$$ !!! ***" * 9] * 9))
    head = "plain words of the text " * 400
    assert quality.features(head, packs) != quality.features(head + "### $$$ !!! ***" * 400, packs)

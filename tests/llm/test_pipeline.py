from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
from test_simhash import plain_classes, plain_fingerprint

from __spark_entry__ import queries
from kickframe.llm import quality

SF = "/root/testdata/sf0.001"


def test_run_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    kept = {r["doc_id"]: r for r in docs.collect() if scores[r["doc_id"]] >= 0.3}
    fps = {i: plain_fingerprint(r["text"]) for i, r in kept.items()}
    roots = plain_classes(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    first: dict = {}
    for i in sorted(kept):
        first.setdefault(roots[fps[i]], i)
    want = set(first.values())
    got = corpus_pipeline.run(spark, SF).collect()
    counts = Counter(r["doc_id"] for r in got)
    assert set(counts) == want and max(counts.values()) <= 2
    # sources: the largest once, none more than twice
    tokens = Counter()
    read = Counter()
    for i in want:
        n = max(1, len(kept[i]["text"].split()))
        tokens[kept[i]["source"]] += n
        read[kept[i]["source"]] += n * counts[i]
    top = max(tokens, key=tokens.get)
    assert read[top] == tokens[top] and all(read[s] <= 2 * tokens[s] for s in tokens)
    for r in got:
        assert r["lossless"] and r["decoded_sha256"] == hashlib.sha256(kept[r["doc_id"]]["text"].encode()).hexdigest()


def test_stages_keep_columns_and_take_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    empty = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_registered():
    names = set(queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))

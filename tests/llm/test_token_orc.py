from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from kickframe.llm import token_orc
from kickframe.llm.bpe import BYTE_BPE, tokenizer_of
from kickframe.session import scratch_path


def plain(rows):
    """(id, start, count, crc) of documents in ascending id order."""
    at = 0
    for i, text in rows:
        ids = [*tokenizer_of(BYTE_BPE).encode(text or "", add_special_tokens=False).ids, token_orc.END]
        yield i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)


def test_query_against_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = [tuple(r) for r in token_orc.query(spark, sf).orderBy("doc_id").collect()]
    assert got == list(plain(docs))


def test_odd_rows(spark, odd_docs):
    path = scratch_path(spark, "t")
    token_orc.write(odd_docs, path)
    got = token_orc.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in odd_docs.collect()], key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == [sum(len(x["tokens"]) for x in got[:k]) for k in range(len(got))]
    texts = {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    read = {(r["doc_id"], tokenizer_of(BYTE_BPE).decode(r["tokens"][:-1], skip_special_tokens=False)) for r in got}
    assert read == texts
    empty = scratch_path(spark, "t")
    token_orc.write(odd_docs.limit(0), empty)
    assert token_orc.read(spark, empty).count() == 0
    assert token_orc.documents_of(spark, empty, [1]).count() == 0


def test_stripes_indexes_and_bloom_filters_prune(spark):
    rows = spark.range(0, 60_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    path = scratch_path(spark, "t")
    token_orc.write(rows, path, stripe_bytes=20_000, stride=1000)
    some = token_orc.documents_of(spark, path, [1001, 1002, 30_000, 70_000])
    assert sorted(r["doc_id"] for r in some.collect()) == [1002, 30_000]
    assert some.inputFiles() != [] and len(some.inputFiles()) <= 4  # data files of the two ranges and the file table
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [In(doc_id" in plan
    # the files themselves: several stripes, a row index and a Bloom filter that knows the ids
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path([f for f in spark.read.orc(path).inputFiles() if "part-" in f][0])
    reader = jvm.org.apache.orc.OrcFile.createReader(file, jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getStripes().size() > 1
    column = reader.getSchema().findSubtype("doc_id").getId()
    own = reader.rows()
    every = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
    for k in range(len(every)):
        every[k] = True
    index = own.readRowIndex(0, every, every)
    assert index.getRowGroupIndex()[column].getEntryCount() >= 1
    assert index.getBloomFilterKinds()[column] is not None
    own.close()

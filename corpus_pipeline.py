"""From raw documents to training pieces: bad documents go, near copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last keep the columns of documents. ``run`` writes each
stage to the shared folder and reads it back, so that a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kickframe.llm import mixing, pieces, quality, simhash
from kickframe.llm.common import table
from kickframe.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. Null and empty texts have a score like any other."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays."""
    return simhash.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of small sources are repeated, up to twice, until the weights are met; every row stays at least once."""
    return mixing.mixed(docs, mixing.Target(repetition=2.0)).select(*(f"`{c}`" for c in docs.columns))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, with a digest of the decoded text."""
    return pieces.encode(docs)


STAGES = [("quality classifier", quality_stage), ("SimHash near-dedup", dedup_stage), ("mixing to target weights", mixing_stage), ("SentencePiece encoding", encoding_stage)]

#: SQL can express neither dictionary compression nor sampled segmentations; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

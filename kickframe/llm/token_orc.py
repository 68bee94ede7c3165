"""Token ids in ORC files: run-length coded ids in stripes, row indexes and Bloom filters on document ids, read stripe by stripe."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickframe.llm.bpe import BYTE_BPE, encoder_of
from kickframe.llm.common import col, map_batches, steps, table
from kickframe.session import python_partitions, scratch_path

#: Closes every document.
END = 2
#: Code points of texts that are encoded together: the more, the fewer words are looked up twice.
STEP = 4_000_000
#: Bytes of text behind one file.
FILE_BYTES = 256_000_000
#: Bytes of a stripe before it is written out: the unit of parallel reads.
STRIPE_BYTES = 16_000_000
#: Rows between two entries of the row index, each with its own Bloom filter.
STRIDE = 1_000
#: Folder of the file table inside the written folder; readers pass over names with an underscore.
FILES = "_files"


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE, end_id: int = END, stripe_bytes: int = STRIPE_BYTES, stride: int = STRIDE) -> None:
    """Encode whole texts and write (doc_id, file, at, n_tokens, tokens) as ORC in ascending id order, with a table of the files.

    ``at`` is where a document begins among the ids of its file, the end id of each document included; the file table has each
    file's first and last id and the number of ids before it. Null texts count as empty, rows without an id come first, repeated
    rows are documents of their own, rows that share an id follow their text; other columns are left out. An empty table gives an
    empty folder that reads as no rows. Files are ranges of (id, hashed text), so rows of one id may fill several files.
    """
    rows = df.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(python_partitions(df.sparkSession), -(-size // FILE_BYTES))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, at = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for a, b in steps(pc.utf8_length(texts).to_pylist(), STEP):
                ids, counts = encode(texts.slice(a, b - a))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(b - a, file), pa.int32()), pa.array(at + ends - counts), pa.array(counts), tokens], ["doc_id", "file", "at", "n_tokens", "tokens"])
                at += int(ends[-1])

    made = dealt.mapInArrow(work, f"doc_id {kind}, file int, at long, n_tokens long, tokens array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(stride), "orc.rows.between.memory.checks": str(stride)}
    made.write.options(**options).orc(path)
    # ids and counts alone are read back for the file table; one row a file
    sums = _data(df.sparkSession, [path], kind).groupBy("file").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    sums.withColumn("before", F.expr("coalesce(sum(tokens) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).coalesce(1).write.orc(f"{path}/{FILES}")


def _data(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    return spark.read.schema(f"doc_id {kind}, file int, at long, n_tokens long, tokens array<int>").orc(paths)


def read(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame:
    """(doc_id, start, tokens) of a written folder, or of some of its files; ``start`` counts the ids of all documents before.

    Tasks read stripes; filters on doc_id reach the stripe statistics, row indexes and Bloom filters, and columns that
    nobody asks for stay unread.
    """
    files = spark.read.orc(f"{path}/{FILES}")
    data = _data(spark, parts or [path], files.schema["first_id"].dataType.simpleString())
    return data.join(files.select("file", "before"), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "tokens")


def documents_of(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The documents with the given ids: the file table names the files to open, the scan skips stripes and row groups by itself."""
    files = spark.read.orc(f"{path}/{FILES}")
    inside = F.lit(False)
    for i in ids:
        inside = inside | F.lit(i).between(F.col("first_id"), F.col("last_id"))
    named = [f"{path}/part-{r['file']:05d}-*" for r in files.where(inside).select("file").collect()]
    return read(spark, path, named).where(F.col("doc_id").isin(ids)) if named else read(spark, path).limit(0)


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows (doc_id, start, tokens): crc32 of the ids as little-endian 32-bit integers."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = batch.column(2)
        ends = tokens.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<u4").view(np.uint8))
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows, work, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_orc")
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return digests(read(spark, path))

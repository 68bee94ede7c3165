"""Readers and sinks: delimited and JSON feeds, snapshots, event logs, stable-schema tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = [",", ";", "\t", "|"]


def header_line(spark: SparkSession, path: str) -> str:
    """First line of a delimited file or folder of files."""
    row = spark.read.text(path).limit(1).first()
    return row[0] if row else ""


def sniff_delimiter(header: str) -> str:
    """The most frequent candidate delimiter of a header line."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, encodings: Sequence[str] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """CSV with unknown delimiter and encoding.

    The delimiter comes from one header line; the first encoding that decodes without replacement characters
    is used. Columns stay text unless a schema is given, so nothing is inferred from the data.
    """
    sep = sniff_delimiter(header_line(spark, path))
    for enc in encodings:
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", enc)
        df = (reader.schema(schema) if schema else reader).csv(path)
        texts = [c for c, t in df.dtypes if t == "string"]
        broken = F.lit(False)
        for c in texts:
            broken = broken | F.coalesce(F.col(c).contains("�"), F.lit(False))
        if enc == encodings[-1] or df.filter(broken).isEmpty():
            return df
    raise AssertionError("unreachable")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first path that exists, in order of priority."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_json_cache(spark: SparkSession, path: str, schema: T.StructType, max_age_seconds: int | None = None) -> DataFrame:
    """A folder of JSON payload files, optionally only those young enough."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    if max_age_seconds is not None:
        age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.col("_metadata.file_modification_time"))
        df = df.filter(age <= max_age_seconds)
    return df


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append metric rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def stable_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the contract's columns in its order, missing ones null, types cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_stable(df: DataFrame, schema: T.StructType, path: str, sort: Sequence[str] = (), partition_by: Sequence[str] = ()) -> None:
    """Stable-schema parquet table, sorted within its files."""
    out = stable_columns(df, schema)
    if sort:
        out = out.sortWithinPartitions(*sort)
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One-row nested report as JSON."""
    df.write.mode("errorifexists").json(path)


def kind_of(name: Column, columns: Iterable[str]) -> Column:
    """Kind of a feed file from its name and header."""
    cols = {c.lower() for c in columns}
    n = F.lower(name)
    return (
        F.when(n.contains("upcoming"), "upcoming")
        .when(n.contains("rating"), "ratings")
        .when(F.lit({"shots", "corners"} <= cols), "stats")
        .when(F.lit({"ft_home", "ft_away"} <= cols), "results")
        .otherwise("other")
    )


def union_all(frames: Iterable[DataFrame], distinct: bool = False) -> DataFrame:
    """Union by name with missing columns as null; optionally exact duplicates removed."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out.distinct() if distinct else out


def newest_snapshot(df: DataFrame, key: str, snapshot: str) -> DataFrame:
    """Row of the newest snapshot per key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(snapshot)).alias("_r")).select(key, "_r.*")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free content hash with the row count; equal tables give equal values."""
    cols = list(columns or df.columns)
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(text)).alias("xor"), F.sum(F.pmod(F.xxhash64(text), F.lit(1_000_003))).alias("sum")
    ).select("rows", F.sha2(F.concat_ws("|", "rows", "xor", "sum"), 256).alias("digest"))

"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared within keys that any two within the radius must share (two of five bit blocks are equal when at
most three bits differ). Inside a key the 64 bit planes of all fingerprints lie vertically, one lane each; a plane XOR-ed
with itself shifted by s lanes gives one difference bit of all pairs (i, i + s) at once, and carry-save counters of
bitwise words add them up. Words whose lanes have all passed the radius are abandoned on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickframe.llm.common import col, map_batches, map_rows, settle
from kickframe.llm.graph import components

SEED = 42
RADIUS = 3
#: Widths of the five bit blocks from the lowest bit; a link of three bits leaves two of them equal.
BLOCKS = (13, 13, 13, 13, 12)
#: Lanes compared in one block; larger keys are cut into sub-blocks that meet pairwise.
LANES = 4096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in parts], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed number) of every row. Null and empty texts have fingerprint 0."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1)
        fps = np.fromiter((fingerprint_of(texts[i].as_py(), shingle) for i in range(len(texts))), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")), work, f"doc_id {kind}, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of n fingerprints as words of 64 lanes, lane i in bit i % 64 of word i // 64."""
    padded = np.zeros(-(-len(fps) // 64) * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _ahead(words: np.ndarray, at: np.ndarray, s: int) -> np.ndarray:
    """Words ``at`` of every bit row, moved so that lane i shows lane i + s; what comes in at the end is not valid."""
    k, r = divmod(s, 64)
    last = words.shape[1] - 1
    out = words[:, np.minimum(at + k, last)] >> np.uint64(r)
    if r:
        out |= words[:, np.minimum(at + k + 1, last)] << np.uint64(64 - r)
    return out


def _tally(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Carry-save sum of bit rows: ones, twos and "four or more" per lane; rows are halved until one is left."""
    one, two, over = d, np.zeros_like(d), np.zeros_like(d)
    while len(one) > 1:
        o1, o2, t1, t2 = one[::2], one[1::2], two[::2], two[1::2]
        carry, twos = o1 & o2, t1 ^ t2
        over = over[::2] | over[1::2] | (t1 & t2) | (twos & carry)
        one, two = o1 ^ o2, twos ^ carry
    return one[0], two[0], over[0]


def close_lanes(planes: np.ndarray, valid: np.ndarray, s: int, radius: int = RADIUS) -> np.ndarray:
    """Lanes i of ``valid`` whose distance to lane i + s is at most the radius (under 4: the counters hold two bits and a carry).

    Half the planes are summed first; words whose lanes have all passed the radius are abandoned before the other half.
    """
    at = np.flatnonzero(valid)
    one, two, over = _tally(planes[:32, at] ^ _ahead(planes[:32], at, s))
    live = (over | ~valid[at]) != FULL
    at, one, two, over = at[live], one[live], two[live], over[live]
    if not len(at):
        return at
    o2, t2, v2 = _tally(planes[32:, at] ^ _ahead(planes[32:], at, s))
    carry, twos = one & o2, two ^ t2
    near = ~(over | v2 | (two & t2) | (twos & carry) | ~valid[at])
    one, two = one ^ o2, twos ^ carry
    for t in range(radius + 1, 4):
        near &= ~((two if t & 2 else ~two) & (one if t & 1 else ~one))
    lanes = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
    return at[lanes // 64] * 64 + lanes % 64


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_block(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys as stars (fp, smallest fp of its group by unsigned order); keys and fps are sorted."""
    n = len(fps)
    parent = np.arange(n)
    lanes = np.arange(n)
    start = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    run = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [n]])))
    size = np.bincount(run)[run]
    planes, s, built = None, 0, 0
    while True:
        s += 1
        keep = size[lanes] > s
        if not keep.any():
            break
        if planes is None or keep.sum() * 2 < built:
            lanes = lanes[keep]
            planes, built = planes_of(fps[lanes]), len(lanes)
        if s >= built:
            break
        same = np.zeros(planes.shape[1] * 64, bool)
        same[: built - s] = run[lanes[:-s]] == run[lanes[s:]]
        hit = close_lanes(planes, np.packbits(same, bitorder="little").view("<u8"), s, radius)
        a, b = lanes[hit], lanes[hit + s]
        for i, j in zip(*(x[parent[a] != parent[b]].tolist() for x in (a, b)), strict=True):
            i, j = _find(parent, i), _find(parent, j)
            parent[max(i, j)] = min(i, j)
        while len(a) and (parent[parent] != parent).any():
            parent = parent[parent]
    odd = np.flatnonzero(parent != np.arange(n))
    return fps[odd], fps[parent[odd]]


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp): the ten keys of each fingerprint, one for every two of the five blocks."""
    cuts = np.cumsum([0, *BLOCKS]).tolist()
    field = [F.shiftrightunsigned("fp", cuts[i]).bitwiseAND((1 << BLOCKS[i]) - 1) for i in range(5)]
    made = [F.lit(t << 26).bitwiseOR(F.shiftleft(field[i], 13)).bitwiseOR(field[j]) for t, (i, j) in enumerate(combinations(range(5), 2))]
    return fps.select("fp", F.explode(F.array(*made)).alias("key"))


def links(fps: DataFrame, radius: int = RADIUS, lanes: int = LANES) -> DataFrame:
    """(u, v): links between different fingerprints of ``fps`` (fp, distinct), as stars per key that lose no connection."""
    if not 0 <= radius <= 3:
        raise ValueError("the five-block keys hold for a radius of 0 to 3")
    keyed = _keys(fps)
    sizes = keyed.groupBy("key").count().where("count > 1")
    met = keyed.join(sizes, "key")
    # a key of m sub-blocks: sub-block i meets every other one, so any two rows share a block of at most two sub-blocks
    m = F.ceil(F.col("count") / lanes).cast("int")
    sub = F.pmod(F.xxhash64("fp"), m).cast("int")
    others = F.when(m == 1, F.array(F.lit(0))).otherwise(F.expr("transform(filter(sequence(0, m - 1), x -> x <> sub), x -> least(x, sub) * m + greatest(x, sub))"))
    split = met.withColumn("m", m).withColumn("sub", sub).select("key", "fp", F.explode(others).alias("part"))
    dealt = split.repartition("key", "part").sortWithinPartitions("key", "part", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in _then_none(batches):
            if batch is not None:
                rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)])
                held.append(rows)
                if sum(x.shape[1] for x in held) < 2 * lanes:
                    continue
            if not held:
                continue
            rows = np.concatenate(held, axis=1)
            end = rows.shape[1]
            if batch is not None:  # the last group may go on in the next batch
                last = (rows[0] == rows[0, -1]) & (rows[2] == rows[2, -1])
                end = int(np.argmax(last))
            held = [rows[:, end:]] if end < rows.shape[1] else []
            if end:
                group = np.concatenate([[0], np.cumsum((np.diff(rows[0, :end]) != 0) | (np.diff(rows[2, :end]) != 0))])
                u, v = link_block(group, rows[1, :end].view(np.uint64), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(work, "u long, v long")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _classes(df: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every fingerprint."""
    docs = settle(fingerprints(df, id_col, text_col, shingle))
    least = settle(docs.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(least.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    classed = least.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    return docs, classed.join(lows, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links, the row's own included.

    Null and empty texts have fingerprint 0 and are linked like any other; a null id stays null in its row and never names
    a component unless all its members are null; repeated rows are returned each; other columns are not read; an empty table
    gives no rows. Copies share one fingerprint and are joined as a class, never as pairs.
    """
    docs, classes = _classes(df, id_col, text_col, shingle, radius)
    return docs.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, all its columns unchanged: that of the smallest id.

    Of a group's rows that repeat that id one stays, and one of a group in which no row has an id; an id that stands for texts of
    several groups keeps a row of each group it is the smallest of. Nulls, empty and repeated texts as in :func:`near_duplicates`.
    """
    docs, classes = _classes(df, id_col, text_col, 3, RADIUS)
    found = settle(docs.join(classes, "fp"))
    first = F.col("doc_id") == F.col("component_id")
    rows = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__kf_rows"), F.count_if(first).alias("__kf_first"))
    rows = rows.where("__kf_first > 0").withColumnRenamed("doc_id", "__kf_id")
    by_id = df.join(rows, col(id_col) == F.col("__kf_id"))
    single = by_id.where("__kf_rows = 1").select(*(col(c) for c in df.columns))
    # an id on several rows, of one group or of several, and groups without an id: their rows are told apart by fingerprint
    at = df.columns.index(text_col)

    def with_fp(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.fromiter((fingerprint_of(x.as_py()) for x in batch.column(at)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*batch.schema.names, "fp"])

    unclear = by_id.where("__kf_rows > 1").select(*(col(c) for c in df.columns)).unionAll(df.where(col(id_col).isNull()))
    wanted = found.where(first | F.col("component_id").isNull()).select(F.col("doc_id").alias("__kf_id"), F.col("fp").alias("__kf_f"), F.col("root").alias("__kf_root")).distinct()
    marked = map_rows(unclear, with_fp, T.StructField("__kf_fp", T.LongType()))
    one = marked.join(wanted, (F.col("__kf_fp") == F.col("__kf_f")) & col(id_col).eqNullSafe(F.col("__kf_id"))).dropDuplicates(["__kf_root"])
    return single.unionAll(one.select(*(col(c) for c in df.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    from kickframe.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

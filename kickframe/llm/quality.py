"""Quality classifier by compression: zstandard dictionaries of good and bad text, calibrated to a score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm.common import col, map_batches, map_rows

#: Bounds of the labelled sample: rows and bytes of text for each label.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 6_000_000
DICT_BYTES = 110_000
#: A text is compressed in frames of this many bytes, so that the dictionary counts over the whole of it.
FRAME = 512
LEVEL = 3
CUT = 0.3


@dataclass(frozen=True)
class Model:
    """The two dictionaries and the logistic curve over the features of :func:`features`."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    bias: float


def packers(good: bytes, bad: bytes):
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **plain)
    return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=params) for d in (good, bad)]


def features(text: str | None, packs) -> tuple[float, float]:
    """(difference, share): (bad size - good size) / (both sizes), and the log of good size over plain size; 0, 0 for an empty text."""
    data = (text or "").encode()
    if not data:
        return 0.0, 0.0
    sizes = [0, 0]
    for at in range(0, len(data), FRAME):
        part = data[at : at + FRAME]
        for k, p in enumerate(packs):
            sizes[k] += len(p.compress(part))
    return (sizes[1] - sizes[0]) / (sizes[0] + sizes[1]), float(np.log(sizes[0] / len(data)))


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: CRC-32 of the id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, most_bytes: int) -> list:
    """At most ``rows`` texts and ``most_bytes`` bytes of each label from the rows that are not held out, in hash order.

    Texts over eight times the mean that the bounds allow are not learnt from, which bounds what the driver receives.
    """
    lab = labels.select(col(id_col).alias("__id"), col(label_col).alias("y")).where("y IN (0, 1)").where(~held_out("__id"))
    lab = lab.groupBy("__id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    texts = docs.select(col(id_col).alias("__id"), col(text_col).cast("string").alias("t")).where(F.octet_length("t").between(1, 8 * most_bytes // rows))
    out = []
    for y in (0, 1):
        # the ids are cut to the bound by a top-k before any text moves: at most ``rows`` ids are broadcast
        ids = F.broadcast(lab.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows))
        got = texts.join(ids, "__id").groupBy("__id").agg(F.min("t").alias("t"))
        held = 0
        for r in sorted(got.withColumn("h", F.xxhash64("__id")).collect(), key=lambda r: (r["h"], r["__id"])):
            held += len(r["t"].encode())
            if held > most_bytes:
                break
            out.append((r["t"], y))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on a bounded sample of labelled rows: one half makes the dictionaries, the other the calibration, then the halves change over.

    Conflicting labels of one id are not used. Without both labels the model is neutral: every score 0.5.
    """
    got = sample(docs, labels, id_col, text_col, label_col, rows, most_bytes)
    by = {y: [t for t, k in got if k == y] for y in (0, 1)}
    if min(map(len, by.values())) < 4:
        return Model(b"", b"", (0.0, 0.0), 0.0)
    xs, ys = [], []
    for half in (0, 1):
        packs = packers(*(dictionary(by[y][half::2]) for y in (1, 0)))
        for y in (0, 1):
            for t in by[y][1 - half :: 2]:
                xs.append(features(t, packs))
                ys.append(y)
    weights, bias = logistic(np.array(xs), np.array(ys, float))
    return Model(dictionary(by[1]), dictionary(by[0]), tuple(weights), bias)


def dictionary(texts: list[str]) -> bytes:
    """Content of a raw dictionary: an equal stretch from the middle of every text, so that no long text fills it."""
    share = max(64, DICT_BYTES // max(1, len(texts)))
    parts = []
    for t in texts:
        data = t.encode()
        at = max(0, (len(data) - share) // 2)
        parts.append(data[at : at + share])
    return b"\n".join(parts)[:DICT_BYTES]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[list[float], float]:
    """Newton fit of a logistic curve, both labels weighted alike, on standardised inputs."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (p - y)) + ridge * beta
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta)), grad)
        beta -= step
        if np.abs(step).max() < 1e-10:
            break
    weights = beta[:-1] / sd
    return weights.tolist(), float(beta[-1] - weights @ mean)


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    if not model.good:
        return np.full(len(texts), 0.5)
    packs = packers(model.good, model.bad)
    x = np.array([features(texts[i].as_py(), packs) for i in range(len(texts))])
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights) + model.bias, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double in 0..1) of every whole text. Null and empty texts get the score of features 0, 0."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), model))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")), work, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; a null id counts as held out, repeated rows are scored alike."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the cut, all columns unchanged."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = scores(batch.column(at), model)
        yield batch.filter(pa.array(found >= cut))

    at = docs.columns.index(text_col)
    return map_rows(docs, work)


def query(spark, sf_dir: str) -> DataFrame:
    from kickframe.llm.common import table

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Cross-tokenizer alignment: links where tokens of two vocabularies end together, counted in inverted pair bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm.bpe import BYTE_BPE, encoder_of, _ranges, token_bytes
from kickframe.llm.common import col, steps, table
from kickframe.llm.pieces import MODEL
from kickframe.session import scratch_path

#: Documents of one block: their numbers inside it fit in 16 bits.
BLOCK = 65_536
#: (pair, document) postings of a block; beyond it a new block begins, so that memory stays bounded.
POSTINGS = 3_000_000
#: Documents of a pair in a block from which a plain bitmap is smaller than the sorted list of numbers.
DENSE = 4_096
#: Ids of the second vocabulary in a pair number.
SHIFT = 1 << 20
STEP = 1_000_000


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    """Bytes of each piece: the space sign is a space, a byte piece its byte, control pieces none."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        out.append(bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace("▁", " ").encode())
    return out


class Bytes:
    """Token bytes laid end to end, to spell many ids at once."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        return self.flat[_ranges(self.start[ids], self.size[ids])].tobytes()


class Decimals:
    """Decimal ids, each with a sign behind it, as rows of bytes."""

    def __init__(self, n: int):
        words = [str(i).encode() + b"," for i in range(n)]
        self.size = np.array([len(w) for w in words], np.int64)
        self.text = np.frombuffer(b"".join(w.ljust(8) for w in words), np.uint8).reshape(n, 8)

    def lay(self, ids: np.ndarray, ends: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each id's bytes end); the ids at ``ends`` are followed by ``signs`` instead of a comma."""
        size = self.size[ids]
        out = self.text[ids][np.arange(8) < size[:, None]]
        upto = np.cumsum(size)
        out[upto[ends] - 1] = signs
        return out, upto


class Aligner:
    """Groups and links of texts between a byte-level vocabulary (A) and a piece vocabulary (B)."""

    def __init__(self, a_path: str, b_path: str):
        self.encode = encoder_of(a_path, True)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a, self.b = Bytes(token_bytes(a_path)), Bytes(piece_bytes(b_path))
        self.decimals = Decimals(max(len(self.a.size), len(self.b.size)))

    def tokens(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(texts that both spell exactly, A ids, A counts, B ids, B counts)."""
        some = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in some]
        a, na = self.encode(spaced)
        coded = self.pieces.encode([texts[k] for k in some], num_threads=1)
        nb = np.array([len(x) for x in coded], np.int64)
        b = np.fromiter((i for x in coded for i in x), np.int64, int(nb.sum()))
        ok, spelt_a, spelt_b = np.zeros(len(some), bool), self.a.spell(a), self.b.spell(b)
        ends = [np.concatenate([[0], np.cumsum(s[i])])[np.concatenate([[0], np.cumsum(n)])].tolist() for s, i, n in ((self.a.size, a, na), (self.b.size, b, nb))]
        for k, t in enumerate(spaced):
            want = t.encode()
            ok[k] = spelt_a[ends[0][k] : ends[0][k + 1]] == want and spelt_b[ends[1][k] : ends[1][k + 1]] == want
        return [k for k, good in zip(some, ok.tolist(), strict=True) if good], a[np.repeat(ok, na)].astype(np.int64), na[ok], b[np.repeat(ok, nb)], nb[ok]

    def __call__(self, texts: list[str | None]):
        """Per text n_a, n_b, n_groups and the digest of the groups, then (text, A id, B id) of every link."""
        n = len(texts)
        kept, a, na, b, nb = self.tokens(texts)
        counts, shas = np.zeros((3, n), np.int64), [""] * n
        if not kept:
            return counts, shas, np.zeros((3, 0), np.int64)
        # texts laid end to end: a text's end is a border of both, so no group reaches over it
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        if not (self.a.size[a].all() and self.b.size[b].all()):
            raise ValueError("a token without bytes has no place in a text")
        borders = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, borders), np.searchsorted(ends_b, borders)
        text_a = np.repeat(np.arange(len(kept)), na)
        of = text_a[last_a]
        groups = np.bincount(of, minlength=len(kept))
        counts[0, kept], counts[1, kept], counts[2, kept] = na, nb, groups
        # A and B ids in the order they are written: group by group, A before B
        group_a, group_b = np.searchsorted(borders, ends_a), np.searchsorted(borders, ends_b)
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
        place_b = np.arange(len(b)) + (last_a + 1)[group_b]
        ids = np.empty(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        marks = np.concatenate([place_a[last_a], place_b[last_b]])
        signs = np.repeat(np.frombuffer(b"|;", np.uint8), len(borders))
        text, upto = self.decimals.lay(ids, marks, signs)
        data = text.tobytes()
        stop = upto[place_b[last_b[np.cumsum(groups) - 1]]].tolist()
        for k, start, end in zip(kept, [0, *stop[:-1]], stop, strict=True):
            shas[k] = hashlib.sha256(data[start : end - 1]).hexdigest()
        return counts, shas, np.stack([np.array(kept)[of], a[last_a], b[last_b]])


class Postings:
    """Pair bitmaps of one block of documents, grown step by step."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.n = 0

    def add(self, docs: np.ndarray, pairs: np.ndarray) -> None:
        """Links of documents not seen before."""
        code, times = np.unique(pairs * BLOCK + docs, return_counts=True)
        self.codes.append(code)
        self.times.append(times)
        self.n += len(code)

    def planes(self) -> dict[str, pa.Array]:
        """One row per pair: its documents (sorted numbers, or a bitmap where that is smaller), the multiplicity planes above the
        first, and popcounts. Plane k has a bit for each document of the pair, set if bit k of its number of links is; a pair
        that no document links twice has no planes."""
        code, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.codes, self.times))
        order = np.argsort(code, kind="stable")
        code, times = code[order], times[order]
        pair, doc = code // BLOCK, (code % BLOCK).astype("<u2")
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        n = np.diff(np.append(first, len(pair)))
        most = np.maximum.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
        # documents
        dense = np.flatnonzero(n > DENSE)
        size = np.where(n > DENSE, BLOCK // 8, 2 * n)
        start = np.cumsum(size) - size
        docs = np.zeros(int(size.sum()), np.uint8)
        thin = np.repeat(n <= DENSE, n)
        docs[_ranges(start[n <= DENSE], size[n <= DENSE])] = doc[thin].view(np.uint8)
        for k in dense.tolist():
            docs[start[k] : start[k] + BLOCK // 8] = bitmap(doc[first[k] : first[k] + n[k]])
        # multiplicities
        high = np.where(most > 1, np.floor(np.log2(np.maximum(most, 1))).astype(np.int64) + 1, 0)
        width = -(-n // 8)
        psize = high * width
        pstart = np.cumsum(psize) - psize
        bits = np.zeros(int(psize.sum()) * 8, bool)
        within = np.arange(len(pair)) - np.repeat(first, n)
        for k in range(int(high.max(initial=0))):
            on = np.flatnonzero((np.repeat(high, n) > k) & (times >> k & 1 == 1))
            row = np.repeat(np.arange(len(n)), n)[on]
            bits[(pstart[row] + k * width[row]) * 8 + within[on]] = True
        planes = np.packbits(bits, bitorder="little")
        links = popcounts(planes, pstart, width, high)
        return {"pair": pa.array(pair[first]), "docs": _binary(docs, size), "planes": _binary(planes, psize), "n_docs": pa.array(n), "n_links": pa.array(np.where(high > 0, links, n))}


def bitmap(docs: np.ndarray) -> np.ndarray:
    out = np.zeros(BLOCK, bool)
    out[docs] = True
    return np.packbits(out, bitorder="little")


def popcounts(planes: np.ndarray, start: np.ndarray, width: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Links of each row: the popcount of plane k counts 2^k times."""
    sums = np.concatenate([[0], np.cumsum(np.bitwise_count(planes), dtype=np.int64)])
    out = np.zeros(len(start), np.int64)
    for k in range(int(high.max(initial=0))):
        row = np.flatnonzero(high > k)
        at = start[row] + k * width[row]
        out[row] += (sums[at + width[row]] - sums[at]) << k
    return out


def unpacked(docs: pa.Array, planes: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, links) of all postings of some rows, laid end to end."""
    data, size = _bytes(docs)
    start = np.cumsum(size) - size
    doc = np.zeros(int(n.sum()), np.int64)
    thin = n <= DENSE
    doc[np.repeat(thin, n)] = data[_ranges(start[thin], size[thin])].view("<u2")
    at = np.cumsum(n) - n
    for k in np.flatnonzero(~thin).tolist():
        doc[at[k] : at[k] + n[k]] = np.flatnonzero(np.unpackbits(data[start[k] : start[k] + size[k]], bitorder="little"))
    bits, psize = _bytes(planes)
    bits, pstart, width = np.unpackbits(bits, bitorder="little"), np.cumsum(psize) - psize, -(-n // 8)
    high = psize // np.maximum(width, 1)
    times = np.repeat((high == 0).astype(np.int64), n)
    for k in range(int(high.max(initial=0))):
        row = np.flatnonzero(high > k)
        times[_ranges(at[row], n[row])] += bits[_ranges((pstart[row] + k * width[row]) * 8, n[row])].astype(np.int64) << k
    return doc, times


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)), np.diff(ends).astype(np.int64)


FIELDS = "block long, doc int, pair long, docs binary, planes binary, n_docs long, n_links long, n_a long, n_b long, n_groups long, groups_sha256 string"


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE, b_path: str = MODEL) -> DataFrame:
    """Both kinds of rows of a table's alignment, written once to the shared folder: documents (pair null) and pair bitmaps (doc null).

    A block holds up to 65,536 documents of one task and a bounded number of postings. Null and empty texts and texts that either
    vocabulary spells otherwise have no tokens; rows without an id and repeated rows are documents of their own; other columns
    are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, number, doc = Aligner(a_path, b_path), Postings(), 0, 0
        task = TaskContext.get().partitionId()

        def close() -> Iterator[pa.RecordBatch]:
            made = held.planes()
            if len(made["pair"]):
                yield _filled(made | {"block": np.full(len(made["pair"]), task << 32 | number)})

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in steps([len(t or "") for t in texts], STEP):
                while a < b:
                    if doc == BLOCK or held.n > POSTINGS:
                        yield from close()
                        held, number, doc = Postings(), number + 1, 0
                    upto = min(b, a + BLOCK - doc)
                    (na, nb, groups), shas, (of, ia, ib) = aligner(texts[a:upto])
                    held.add(doc + of, ia * SHIFT + ib)
                    yield _filled({"id": batch.column(0).slice(a, upto - a), "block": np.full(upto - a, task << 32 | number), "doc": np.arange(doc, doc + upto - a), "n_a": na, "n_b": nb, "n_groups": groups, "n_links": groups, "groups_sha256": shas})
                    doc += upto - a
                    a = upto
        yield from close()

    schema = f"id {kind}, {FIELDS}"
    types = dict(zip([f.split()[0] for f in schema.split(", ")], [_arrow(df, id_col), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.string()], strict=True))

    def _filled(cols: dict) -> pa.RecordBatch:
        n = len(cols["block"])
        arrays = [cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in types.items()]
        return pa.RecordBatch.from_arrays(arrays, list(types))

    path = scratch_path(df.sparkSession, "align")
    df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(work, schema).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, b, docs, links, best): popcounts of a pair's bitmaps over all blocks; ``best`` if no pair of the same B id has more links."""
    counts = rows.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n_docs").alias("docs"), F.sum("n_links").alias("links"))
    counts = counts.select("pair", F.expr(f"pair DIV {SHIFT}").alias("a"), (F.col("pair") % SHIFT).alias("b"), "docs", "links")
    # one row per id of the second vocabulary
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "docs", "links", (F.col("links") == F.col("most")).alias("best"))


def scores(rows: DataFrame) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document: the postings bring each pair's count back.

    A pair's bitmaps meet its count by the pair's number, then a block's bitmaps meet its documents; a block streams through one
    task with two sums per document.
    """
    kind = rows.schema["id"].dataType.simpleString()
    marked = rows.where("pair IS NOT NULL").select("block", "pair", "docs", "planes", "n_docs").join(pair_counts(rows).select("pair", "links", "best"), "pair")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("docs", "binary"), ("planes", "binary"), ("n_docs", "long"), ("links", "long"), ("best", "boolean"))]
    facts = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    documents = rows.where("pair IS NULL").select("block", "doc", *nothing, "id", *facts)
    named = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", *facts)]
    met = marked.select("block", F.lit(None).cast("int").alias("doc"), "docs", "planes", "n_docs", "links", "best", *named).unionByName(documents)
    # bitmaps of a block come first (doc null), then its documents
    met = met.repartition("block").sortWithinPartitions("block", "doc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, best = None, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if block[a] != at:
                    at = block[a]
                    total[:], best[:] = 0, 0
                split = part.column(1).null_count
                if split:
                    pairs = part.slice(0, split)
                    n = pairs.column(4).to_numpy()
                    doc, times = unpacked(pairs.column(2), pairs.column(3), n)
                    np.add.at(total, doc, times * np.repeat(pairs.column(5).to_numpy(), n))
                    np.add.at(best, doc, times * np.repeat(pairs.column(6).to_numpy(zero_copy_only=False).astype(np.int64), n))
                if split < b - a:
                    docs = part.slice(split)
                    of = docs.column(1).to_numpy()
                    cols = [docs.column(7), *(docs.column(k) for k in (8, 9, 10, 11)), pa.array(best[of]), pa.array(total[of]), docs.column(12)]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return met.mapInArrow(work, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(index(docs)).withColumnRenamed("id", "doc_id")

"""SentencePiece encoding and decoding: segmentations sampled by forward filtering and backward sampling over the piece lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from kickframe.llm.common import col, map_batches, steps, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Zipf-Mandelbrot offset: a model of merge ranks gives piece of rank r the weight 1 / (r + OFFSET).
OFFSET = 50.0
#: Log weight added per code point: the same for all segmentations of a text, it keeps sums near 1.
LIFT = 3.0
#: Chunks up to this length are summed as plain numbers, longer ones as logarithms.
PLAIN = 150
#: Code points of distinct chunks whose lattices are held at once.
GROUP = 100_000
#: Code points of texts that are encoded together: with GROUP they set the memory of a worker.
STEP = 1_000_000
DENSE = 256


class Lattice:
    """The pieces of a model as a trie in arrays, with a log weight for each."""

    def __init__(self, path: str, alpha: float = 1.0):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        pieces = {i: sp.id_to_piece(i) for i in range(n) if i not in special}
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
        for i, p in pieces.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        if sum(map(sp.is_byte, range(n))) != 256:
            raise ValueError("the model has no byte pieces; unknown characters would be lost")
        scores = np.array([sp.get_score(i) for i in pieces])
        ranks = len(scores) > 1 and bool((scores == np.round(scores)).all())
        self.log = {i: alpha * (-np.log(OFFSET - s) if ranks else s) for i, s in zip(pieces, scores.tolist(), strict=True)}
        self.log_byte = min(self.log.values()) - alpha
        self.marker = n
        # characters by number; 0: in no piece. A space stands for the model's space sign, whose own character goes by bytes
        chars = sorted({c for p in pieces.values() for c in p}, key=lambda c: (c != SPACE, c))
        self.cid = np.zeros(0x110000, np.int32)
        number = {c: k for k, c in enumerate(chars, 1)}
        for c, k in number.items():
            self.cid[32 if c == SPACE else ord(c)] = k
        self.width = len(chars) + 1
        nodes: list[dict[str, int]] = [{}]
        ends, logs, keys, kids = [-1], [0.0], [], []
        for i, p in pieces.items():
            at = 0
            for c in p:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    keys.append(at * self.width + number[c])
                    kids.append(len(nodes))
                    nodes.append({})
                    ends.append(-1)
                    logs.append(0.0)
                at = nodes[at][c]
            ends[at], logs[at] = i, self.log[i]
        order = np.argsort(keys)
        self.keys, self.kids = np.array(keys)[order], np.array(kids, np.int32)[order]
        self.ends, self.logs = np.array(ends, np.int32), np.array(logs)
        self.first = np.zeros(self.width, np.int32)
        for c, k in nodes[0].items():
            self.first[number[c]] = k
        self.longest = max(map(len, pieces.values()))
        # of characters numbered under DENSE: pairs that stand side by side in some piece, and the trie's second level
        self.beside = np.zeros((DENSE, DENSE), bool)
        self.second = np.zeros((DENSE, DENSE), np.int32)
        for p in pieces.values():
            for a, b in zip(p, p[1:], strict=False):
                if number[a] < DENSE and number[b] < DENSE:
                    self.beside[number[a], number[b]] = True
            if len(p) > 1 and number[p[0]] < DENSE and number[p[1]] < DENSE:
                self.second[number[p[0]], number[p[1]]] = nodes[nodes[0][p[0]]][p[1]]

    def cuts(self, cid: np.ndarray) -> np.ndarray:
        """True where no piece reaches over from the character before: chunks that begin there are encoded on their own."""
        a, b = cid[:-1], cid[1:]
        cut = np.ones(len(cid), bool)
        both = (a < DENSE) & (b < DENSE)
        np.logical_not(np.where(both, self.beside[np.where(both, a, 0), np.where(both, b, 0)], (a > 0) & (b > 0)), out=cut[1:])
        return cut

    def edges(self, codes: np.ndarray, lens: np.ndarray):
        """(start node, length, log weight, piece) of all pieces in chunks laid end to end; node = character index + chunk index."""
        cid = self.cid[codes]
        chunk = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        left = (np.repeat(np.cumsum(lens), lens) - np.arange(len(codes))).astype(np.int32)
        at, node = np.arange(len(codes), dtype=np.int32), self.first[cid]
        found = []
        odd = np.flatnonzero((node == 0) | (self.ends[node] < 0)).astype(np.int32)
        if len(odd):
            c = codes[odd]
            size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            found.append((odd + chunk[odd], np.ones(len(odd), np.int32), size * self.log_byte, np.where(c < 128, self.byte_id[np.minimum(c, 127)], self.marker).astype(np.int32)))
        for n in range(1, self.longest + 1):
            if n > 1:
                more = left[at] >= n
                at, node = at[more], node[more]
                now = cid[at + (n - 1)]
                if n == 2:
                    kid = self._step(node, now, cid[at])
                else:
                    kid = self._step(node, now)
                hit = kid > 0
            else:
                kid, hit = node, node > 0
            at, node = at[hit], kid[hit]
            if not len(at):
                break
            t = self.ends[node] >= 0
            found.append((at[t] + chunk[at[t]], np.full(t.sum(), n, np.int32), self.logs[node[t]], self.ends[node[t]]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def _step(self, node: np.ndarray, now: np.ndarray, was: np.ndarray | None = None) -> np.ndarray:
        """Child nodes, 0 where there is none; the second level is read from a table."""
        if was is not None:
            dense = (was < DENSE) & (now < DENSE)
            if dense.all():
                return self.second[was, now]
            kid = np.zeros(len(node), np.int32)
            kid[dense] = self.second[was[dense], now[dense]]
            kid[~dense] = self._step(node[~dense], now[~dense])
            return kid
        key = node.astype(np.int64) * self.width + now
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.kids[spot], 0)


class Sampler:
    """Forward sums over the lattices of distinct chunks; backward draws for all their occurrences at once."""

    def __init__(self, lattice: Lattice, codes: np.ndarray, lens: np.ndarray):
        self.base = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        start, size, log, self.piece = lattice.edges(codes, lens)
        local = start - np.repeat(self.base, lens + 1)[start]
        stop, end = local + size, start + size
        n_nodes = int(self.base[-1] + lens[-1] + 1)
        order = np.lexsort((end, stop)) if int(stop.max()) >= 1 << 15 else np.argsort(end, kind="stable")
        if int(stop.max()) < 1 << 15:  # small numbers are sorted by radix
            order = order[np.argsort(stop[order].astype(np.int16), kind="stable")]
        start, size, log, stop, end, self.piece = start[order], size[order], log[order], stop[order], end[order], self.piece[order]
        self.back = size
        # edges that end at one node are a run
        head = np.concatenate([[0], np.flatnonzero(np.diff(end)) + 1])
        self.run_at, self.run_to = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
        self.run_at[end[head]] = head
        self.run_to[end[head]] = np.concatenate([head[1:], [len(end)]])
        level = np.concatenate([[0], np.flatnonzero(np.diff(stop[head])) + 1, [len(head)]])
        most = int(lens.max())
        part = np.zeros(len(end))
        total = np.zeros(n_nodes)
        if most <= PLAIN:
            weight = np.exp(log + LIFT * size)
            total[self.base] = 1.0
            for a, b in zip(level[:-1], level[1:], strict=True):
                lo, hi = head[a], head[b] if b < len(head) else len(end)
                part[lo:hi] = total[start[lo:hi]] * weight[lo:hi]
                total[end[head[a:b]]] = np.add.reduceat(part[lo:hi], head[a:b] - lo)
            part /= total[end]
        else:
            for a, b in zip(level[:-1], level[1:], strict=True):
                lo, hi = head[a], head[b] if b < len(head) else len(end)
                part[lo:hi] = total[start[lo:hi]] + log[lo:hi]
                peak = np.maximum.reduceat(part[lo:hi], head[a:b] - lo)
                runs = np.diff(np.concatenate([head[a:b], [hi]]))
                total[end[head[a:b]]] = peak + np.log(np.add.reduceat(np.exp(part[lo:hi] - np.repeat(peak, runs)), head[a:b] - lo))
            part = np.exp(part - total[end])
        # running sums inside each run, edge by edge, so that they don't depend on what else is in the batch
        rank = np.arange(len(end)) - np.repeat(head, np.diff(np.concatenate([head, [len(end)]])))
        for k in range(1, int(rank.max(initial=0)) + 1):
            sel = np.flatnonzero(rank == k)
            part[sel] += part[sel - 1]
        self.cum, self.lens = part, lens

    def draw(self, chunk: np.ndarray, place: np.ndarray, where: np.ndarray, seed: np.ndarray, out: np.ndarray) -> None:
        """For each occurrence put its pieces at their end positions in ``out``. place: in the row's text, for the draw; where: in ``out``."""
        pos = self.lens[chunk].copy()
        live = np.flatnonzero(pos > 0)
        while len(live):
            node = self.base[chunk[live]] + pos[live]
            u = uniform(seed[live], place[live] + pos[live])
            e, last = self.run_at[node], self.run_to[node] - 1
            go = np.flatnonzero((e < last) & (u >= self.cum[e]))
            while len(go):
                e[go] += 1
                go = go[(e[go] < last[go]) & (u[go] >= self.cum[e[go]])]
            out[where[live] + pos[live]] = self.piece[e]
            pos[live] -= self.back[e]
            live = live[pos[live] > 0]


def uniform(seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number in [0, 1) that only a row's seed and a position decide (a 64-bit finaliser over a counter)."""
    with np.errstate(over="ignore"):
        z = seed + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / float(1 << 53)


@lru_cache(maxsize=2)
def lattice_of(path: str, alpha: float) -> Lattice:
    return Lattice(path, alpha)


def distinct_chunks(codes: np.ndarray, begin: np.ndarray, lattice: Lattice):
    """(start, length, kind of each chunk; start of the first chunk of each kind), chunks being alike exactly if their characters are."""
    cut = lattice.cuts(lattice.cid[codes])
    cut[begin[begin < len(codes)]] = True
    starts = np.flatnonzero(cut)
    lens = np.diff(np.concatenate([starts, [len(codes)]]))
    local = np.arange(len(codes)) - np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lens.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        hashes = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * powers[local], starts)
    _, rep, kind = np.unique(hashes, return_index=True, return_inverse=True)
    # the hash only proposes: characters are compared, and a collision falls back to the strings themselves
    alike = np.array_equal(lens, lens[rep][kind]) and np.array_equal(codes, codes[np.repeat(starts[rep][kind], lens) + local])
    if not alike:
        known: dict[bytes, int] = {}
        kind = np.array([known.setdefault(codes[s : s + n].tobytes(), len(known)) for s, n in zip(starts.tolist(), lens.tolist(), strict=True)])
        rep = np.unique(kind, return_index=True)[1]
    return starts, lens, kind, rep


def encode_rows(texts: list[str], seeds: list[int], lattice: Lattice) -> list[np.ndarray]:
    """Piece ids of each text; an empty text has none. A space is put before each text, as the model's encoder does."""
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])])
    codes = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), "<u4").astype(np.int32)
    if not len(codes):
        return [np.zeros(0, np.int32) for _ in texts]
    starts, lens, kind, rep = distinct_chunks(codes, begin[:-1], lattice)
    row = np.searchsorted(begin, starts, side="right") - 1
    place, seed = starts - begin[row], np.array(seeds, np.uint64)[row]
    out = np.full(len(codes) + 1, -1, np.int32)
    # kinds of one group have their lattices at once; long chunks, summed in logarithms, are groups of their own
    size = lens[rep]
    by_len = np.argsort(size > PLAIN, kind="stable")
    plain = int((size <= PLAIN).sum())
    ends = np.cumsum(size[by_len])
    group = np.where(np.arange(len(rep)) < plain, (ends - 1) // GROUP, (ends - 1) // GROUP + int(ends[-1]))
    head = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    order = np.empty(len(rep), np.int64)
    order[by_len] = np.arange(len(rep))
    at = order[kind]
    sorted_occ = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[sorted_occ], head)
    for a, b, lo, hi in zip(head[:-1], head[1:], edge[:-1], edge[1:], strict=True):
        own, occ = by_len[a:b], sorted_occ[lo:hi]
        n = size[own]
        text = codes[np.repeat(starts[rep[own]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        Sampler(lattice, text, n).draw(at[occ] - a, place[occ], starts[occ], seed[occ], out)
    done = []
    for i in range(len(texts)):
        got = out[begin[i] + 1 : begin[i + 1] + 1]
        spots = np.flatnonzero(got >= 0)
        got = got[spots]
        if (got == lattice.marker).any():
            own = codes[begin[i] : begin[i + 1]]
            got = np.concatenate([lattice.byte_id[list(chr(own[p]).encode())] if g == lattice.marker else [g] for g, p in zip(got, spots, strict=True)])
        done.append(got.astype(np.int32))
    return done


def decode_row(ids: np.ndarray, lattice: Lattice) -> str:
    """The text of piece ids, without the space that the encoder put before it."""
    return b"".join(map(lattice.bytes_of.__getitem__, ids.tolist())).decode()[1:] if len(ids) else ""


def seed_of(key, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(key), seed)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 11, check: bool = True) -> DataFrame:
    """(doc_id, piece_ids, n_pieces, decoded_sha256, lossless) of every row.

    A segmentation has the product of its pieces' weights as its probability (to the power ``alpha``); forward sums over
    the lattice and draws backwards from the end give an exact sample. Draws hang on the row's id, its place in the text and
    ``seed`` only. Pieces never reach over a chunk's border, so that each distinct chunk of a batch is summed once.
    Decoding gives back the text exactly; characters that the model lacks go by byte pieces. A null text has null
    pieces, an empty one none (both count 0 and are lossless); rows that repeat an id and text get the same pieces.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model, alpha)
        for a, b in steps(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist(), STEP):
            keys, texts = (c.slice(a, b - a).to_pylist() for c in batch.columns)
            got = encode_rows([t or "" for t in texts], [seed_of(k, seed) for k in keys], lattice)
            flat = pa.array(np.concatenate(got))
            counts = np.fromiter(map(len, got), np.int64, len(got))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
            back = [decode_row(g, lattice) for g in got] if check else [t or "" for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, flat), pa.array(counts),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == (t or "") for x, t in zip(back, texts, strict=True)]),
                ],
                ["doc_id", "piece_ids", "n_pieces", "decoded_sha256", "lossless"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")), work, f"doc_id {kind}, piece_ids array<int>, n_pieces long, decoded_sha256 string, lossless boolean")


def decode(df: DataFrame, id_col: str = "doc_id", pieces_col: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) from piece ids; null pieces give a null text."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model, 1.0)
        texts = [None if p is None else decode_row(np.array(p, np.int64), lattice) for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(col(id_col).alias("doc_id"), col(pieces_col).alias("p")), work, f"doc_id {kind}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))

"""Conversation prefix trie: z-fast tries over sorted batches of conversations, expanded to one node per shared prefix and merged at their borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm.common import col, map_batches, settle, table
from kickframe.session import scratch_path

#: Turns of the distinct conversations that one batch inserts; a longer conversation is a batch of its own.
BATCH_TURNS = 200_000
#: Ids that are joined to one text before a node's ids are digested.
CHUNK = 8_192
NO_IDS = hashlib.sha256(b"").hexdigest()


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class Node:
    """A compacted node: the first ``depth`` turns of ``keys`` spell it, the edge to it begins behind depth ``up``."""

    __slots__ = ("chars", "conv", "depth", "digest", "keys", "kids", "leaves", "n", "own", "parent", "saved", "up")

    def __init__(self, keys: list[bytes], chars: list[int], up: int, depth: int, parent: Node | None):
        self.keys, self.chars, self.up, self.depth, self.parent = keys, chars, up, depth, parent
        self.n, self.conv, self.digest = 0, None, None
        self.kids = self.leaves = self.saved = self.own = 0

    def handle(self) -> bytes:
        return self.keys[two_fattest(self.up, self.depth) - 1]


class ZFastTrie:
    """Sequences of prefix keys. Key d of a sequence stands for its first d turns, so equal keys mean equal prefixes."""

    def __init__(self) -> None:
        self.root = Node([], [], 0, 0, None)
        self.nodes = [self.root]
        self.handles: dict[bytes, Node] = {}
        self.first: dict[bytes, Node] = {}

    def locate(self, keys: list[bytes]) -> tuple[Node, Node | None]:
        """(deepest node that is a prefix of ``keys``, the node below it on whose edge ``keys`` leaves the trie), by fat binary search."""
        node, a, b = self.root, 0, len(keys)
        while a < b:
            got = self.handles.get(keys[two_fattest(a, b) - 1])
            if got is None:
                b = two_fattest(a, b) - 1
            elif got.depth <= len(keys) and keys[got.depth - 1] == got.keys[got.depth - 1]:
                node, a = got, got.depth
            else:
                return got.parent, got
        return node, self.first.get(keys[node.depth]) if node.depth < len(keys) else None

    def _hang(self, keys: list[bytes], chars: list[int], depth: int, parent: Node) -> Node:
        made = Node(keys, chars, parent.depth, depth, parent)
        self.nodes.append(made)
        self.handles[made.handle()] = made
        self.first[keys[parent.depth]] = made
        return made

    def insert(self, keys: list[bytes], chars: list[int]) -> Node:
        """The node of a whole sequence, which splits an edge where it leaves one."""
        node, left = self.locate(keys)
        if left is not None:
            # the longest common prefix lies on the edge: bisect its keys
            low, high = left.up + 1, min(len(keys), left.depth)
            while low < high:
                mid = (low + high + 1) // 2
                if keys[mid - 1] == left.keys[mid - 1]:
                    low = mid
                else:
                    high = mid - 1
            del self.handles[left.handle()]
            node = self._hang(left.keys, left.chars, low, node)
            left.up, left.parent = low, node
            self.handles[left.handle()] = left
            self.first[left.keys[low]] = left
        return node if node.depth == len(keys) else self._hang(keys, chars, len(keys), node)


FIELDS = ["batch", "border", "key", "depth", "conv_id", "parent_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars", "ends_sha256"]
SCHEMA = "batch long, border boolean, key binary, depth long, conv_id long, parent_key binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string"


def expanded(trie: ZFastTrie, border: set[bytes], batch: int) -> Iterator[tuple]:
    """One row per node of the expanded edges.

    Nodes off the border have all their members in this batch and get their final figures; a border node may go on in another
    batch and gets its members here and sums over its children off the border. A child of a border node names its parent by key.
    """
    order = sorted(trie.nodes, key=lambda v: -v.depth)
    for v in order:
        if v.parent is not None:
            v.parent.n += v.n
            v.parent.conv = v.conv if v.parent.conv is None else min(v.conv, v.parent.conv)
    for v in order:
        kids, leaves, saved = v.kids, v.leaves, v.saved
        for d in range(v.depth, v.up, -1):
            key, above = v.keys[d - 1], v.keys[d - 2] if d > 1 else b""
            at_border, parent_border = key in border, above in border
            if not at_border:
                leaves = leaves or 1
                saved += (v.n - 1) * v.chars[d - 1]
            parent_conv = None if parent_border else v.conv if d > v.up + 1 else v.parent.conv
            yield batch, at_border, key, d, v.conv, above if parent_border else None, parent_conv, v.n, kids, leaves, saved, v.chars[d - 1], v.digest if d == v.depth else None
            kids, leaves, saved = (0, 0, 0) if at_border else (1, leaves, saved)
        if v.parent is not None:
            v.parent.kids += kids
            v.parent.leaves += leaves
            v.parent.saved += saved
    r = trie.root
    yield batch, True, b"", 0, r.conv, None, None, r.n, r.kids, r.leaves, r.saved, 0, r.digest


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, digests, chars): a conversation's turns in order, null turns first, as digests and lengths; texts stay where they are.

    Rows without a conversation id belong to none and are left out; null roles and texts count as empty; rows that share a turn
    are ordered by their digest, repeated rows are turns of their own. A conversation is one row of 16 bytes and a number a turn.
    """
    role_, text_ = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.where(col(conv).isNotNull()).select(col(conv).cast("long").alias("conv_id"), col(turn).alias("turn"), F.unhex(F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_))).alias("digest"), F.length(text_).alias("chars"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("t"))
    return held.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.chars").alias("chars"))


def keyed(convs: DataFrame) -> DataFrame:
    """(conv_id, key, keys, chars): key d digests the first d turns; ``key`` is the last one, empty without turns."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = []
        for digests in batch.column(1).to_pylist():
            at, own = b"", []
            for d in digests:
                at = hashlib.blake2b(at + d, digest_size=16).digest()
                own.append(at)
            keys.append(own)
        last = [k[-1] if k else b"" for k in keys]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(last, pa.binary()), pa.array(keys, pa.list_(pa.binary())), batch.column(2)], ["conv_id", "key", "keys", "chars"])

    return map_batches(convs.select("conv_id", "digests", F.col("chars").cast("array<int>").alias("chars")), work, "conv_id long, key binary, keys array<binary>, chars array<int>")


def ends(rows: DataFrame) -> DataFrame:
    """(key, conv_id, n, ends_sha256) of every distinct whole conversation: its smallest id, its copies and the digest of all their ids.

    Ids are sorted and joined to texts of up to 8,192 in ranges of (key, id), so that a third of all conversations under
    one key is sorted and written by many tasks; only the digest itself, which has one order, runs over a key's texts in one.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        made: list[tuple] = []
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or len(ids) == CHUNK:
                    if ids:
                        made.append((key, ids[0], len(ids), ",".join(map(str, ids))))
                    key, ids = k, []
                ids.append(c)
            if made:
                yield _batch(made, ["key", "conv_id", "n", "ids"])
                made = []
        if ids:
            yield _batch([(key, ids[0], len(ids), ",".join(map(str, ids)))], ["key", "conv_id", "n", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, sha, made = None, None, 0, None, []
        for batch in batches:
            for k, c, m, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    if sha is not None:
                        made.append((key, first, n, sha.hexdigest()))
                    key, first, n, sha = k, c, 0, hashlib.sha256()
                sha.update((("," if n else "") + ids).encode())
                n += m
            if made:
                yield _batch(made, ["key", "conv_id", "n", "ends_sha256"])
                made = []
        if sha is not None:
            yield _batch([(key, first, n, sha.hexdigest())], ["key", "conv_id", "n", "ends_sha256"])

    texts = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, conv_id long, n long, ids string")
    return texts.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(digest, "key binary, conv_id long, n long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"key": pa.binary(), "parent_key": pa.binary(), "ids": pa.string(), "ends_sha256": pa.string(), "border": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.int64())) for x, c in zip(zip(*rows, strict=True), names, strict=True)], names)


def batches_of(sequences: DataFrame, most: int = BATCH_TURNS) -> DataFrame:
    """Node rows of all batches. Sequences are sorted by their keys, so batches share no node but prefixes of their first and last one."""

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, turns = TaskContext.get().partitionId(), 0, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            trie = ZFastTrie()
            for keys, chars, conv, n, digest in held:
                node = trie.insert(keys, chars)
                node.n, node.conv, node.digest = n, conv, digest
            border = {b"", *held[0][0], *held[-1][0]}
            rows = []
            for row in expanded(trie, border, task << 32 | number):
                rows.append(row)
                if len(rows) == 20_000:
                    yield _batch(rows, FIELDS)
                    rows = []
            if rows:
                yield _batch(rows, FIELDS)

        for batch in arrived:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and turns + len(row[0]) > most:
                    yield from close()
                    held, turns, number = [], 0, number + 1
                held.append(row)
                turns += len(row[0])
        if held:
            yield from close()

    dealt = sequences.select("keys", "chars", "conv_id", "n", "ends_sha256").repartitionByRange("keys").sortWithinPartitions("keys")
    return dealt.mapInArrow(work, SCHEMA)


def merged_border(border: DataFrame) -> DataFrame:
    """Border nodes of all batches as one each, with sums over their subtrees.

    Subtree sums double their reach each round: what a node knows goes to its 2^k-th ancestor, whose own ancestor is
    looked up for the next round. So a chain of d nodes takes log2(d) rounds of joins and aggregates.
    """
    one = border.groupBy("key").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("parent_key", True).alias("parent_key"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("chars").alias("chars"), F.max("ends_sha256").alias("ends_sha256"),
    )
    one = settle(one)
    kids = one.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    own = one.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = settle(own.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")))
    state = own.select("key", F.col("parent_key").alias("up"), "n_leaves", "saved_tokens")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest.bit_length()):
        gain = state.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        higher = state.select(F.col("key").alias("up"), F.col("up").alias("next"))
        state = state.join(gain, "key", "left").join(higher, "up", "left").select("key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
        state = settle(state)
    parents = own.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return own.drop("n_leaves", "saved_tokens").join(state.drop("up"), "key").join(parents, "parent_key", "left")


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(convs: DataFrame, most: int = BATCH_TURNS) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, digests, chars), the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): smallest member, turns, the
    parent's smallest member, members, children, childless nodes of the subtree, characters that sharing saves in the subtree,
    and the digest of the ids that end here. Ids are unique. No sequences: no nodes. Equal sequences are one; distinct ones are
    sorted over all tasks, whatever their first turn, and inserted into one z-fast trie a batch; batches meet only in the
    prefixes of their first and last sequences.
    """
    spark = convs.sparkSession
    rows = settle(keyed(convs))
    sequences = ends(rows).join(rows.select("conv_id", "keys", "chars"), "conv_id")
    path = scratch_path(spark, "trie")
    batches_of(sequences, most).write.parquet(path)
    nodes = spark.read.parquet(path)
    border, inner = nodes.where("border"), nodes.where("NOT border")
    top = merged_border(border)
    # a batch's own border nodes bring the parent's figure back, so that children of one hot node stay with their batches
    known = border.select("batch", F.col("key").alias("parent_key")).join(top.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("top_conv")), "parent_key")
    below = inner.where("parent_key IS NOT NULL").join(known, ["batch", "parent_key"]).withColumn("parent_conv_id", F.col("top_conv"))
    parts = [inner.where("parent_key IS NULL"), below, top]
    out = parts[0].select(OUT)
    for p in parts[1:]:
        out = out.unionAll(p.select(OUT))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % 100, h = crc32(decimal c) % 6."""
    own = convs.select("*", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int").alias("h"))
    heads = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("digests", 1, 5).alias("d"), F.slice("chars", 1, 5).alias("c"))
    joined = own.join(heads, "base", "left")
    new = lambda head, own: F.concat(F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.slice(own, 1, 0)), F.expr(f"slice({own}, h + 1, greatest(size({own}) - h, 0))"))
    return joined.select("conv_id", new("d", "digests").alias("digests"), new("c", "chars").alias("chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), t AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc
), r AS (
  SELECT c.conv_id, 0 AS part, pos, chars, turn_key FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, chars, turn_key FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
), p AS (
  SELECT conv_id, row_number() OVER w AS d, chars, md5(string_agg(turn_key, '') OVER w) AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), e AS (
  SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(k, d) AS k FROM p GROUP BY conv_id) GROUP BY k
), n AS (
  SELECT p.k, any_value(p.d) AS d, min(p.conv_id) AS conv_id, count(*) AS members, any_value(p.chars) AS chars, any_value(q.k) AS parent
  FROM p LEFT JOIN p q ON q.conv_id = p.conv_id AND q.d = p.d - 1 GROUP BY p.k
), kids AS (SELECT parent, count(*) AS kids FROM n GROUP BY parent
), s AS (
  SELECT a.k, count(*) FILTER (kids.kids IS NULL) AS leaves, sum((n.members - 1) * n.chars) AS saved
  FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d LEFT JOIN kids ON kids.parent = n.k GROUP BY a.k
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.members AS n_convs, coalesce(kids.kids, 0) AS n_children, s.leaves AS n_leaves,
  s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN kids ON kids.parent = n.k LEFT JOIN e ON e.k = n.k LEFT JOIN n u ON u.k = n.parent
"""

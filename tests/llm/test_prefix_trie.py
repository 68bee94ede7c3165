from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from check_queries import compare, connect

from kickframe.llm import prefix_trie as pt


def plain(sequences):
    """Nodes of {conv_id: tuple of (key, chars)}, one by one."""
    members, kids, ends = {}, {}, {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
            if d:
                kids.setdefault(s[: d - 1], set()).add(s[:d])
        ends.setdefault(s, []).append(c)

    def leaves(p):
        return sum(map(leaves, kids[p])) if p in kids else 1

    def saved(p):
        return (len(members[p]) - 1) * (p[-1][1] if p else 0) + sum(map(saved, kids.get(p, ())))

    for p, m in members.items():
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), leaves(p), saved(p), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()


def test_z_fast_trie_finds_every_exit():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choices("ab", k=rng.choice([0, 1, 2, 3, 5, 9, 17, 40]))) for _ in range(rng.randint(1, 30))]
        keys = lambda t: [t[: d + 1].encode() for d in range(len(t))]
        trie, held = pt.ZFastTrie(), set()
        for t in texts:
            node = trie.insert(keys(t), [1] * len(t))
            held.add(t)
            assert node.depth == len(t)
            assert len(trie.handles) == len(trie.nodes) - 1
        spelt = {v.keys[v.depth - 1].decode() if v.depth else "" for v in trie.nodes}
        branching = {t[:d] for t in held for d in range(len(t) + 1) if len({u[d : d + 1] for u in held if u.startswith(t[:d])} - {""}) > 1}
        assert spelt == held | branching | {""}
        for _ in range(20):
            t = "".join(rng.choices("ab", k=rng.randint(0, 20)))
            node, left = trie.locate(keys(t))
            assert (node.keys[node.depth - 1].decode() if node.depth else "") == max((s for s in spelt if t.startswith(s)), key=len)
            below = [v for v in trie.nodes if v.parent is node and v.up < len(t) and v.keys[v.up].decode() == t[: v.up + 1]]
            assert ([left] if left else []) == below


@pytest.mark.parametrize("most", [1, 7, 40, 100_000])
def test_trie_equals_plain_nodes_for_any_batches(spark, most):
    rng = random.Random(most)
    rows = {}
    for c in range(150):
        start = rng.choice([(), ("hot",), ("hot",), ("hot", "x"), ("hot", "x", "y", "z")])
        rows[c] = start + tuple(rng.choices("abc", k=rng.choice([0, 0, 1, 2, 3, 6])))
    rows[900] = tuple("chain" for _ in range(60))
    rows[901] = rows[900][:33]
    df = spark.createDataFrame([(c, [t.encode() for t in s], [len(t) for t in s]) for c, s in rows.items()], "conv_id long, digests array<binary>, chars array<int>")
    got = sorted(tuple(r) for r in pt.trie(df, most).collect() if r["depth"])
    root = [tuple(r) for r in pt.trie(df, most).where("depth = 0").collect()]
    want = list(plain({c: tuple((t, len(t)) for t in s) for c, s in rows.items()}))
    assert got == sorted(w for w in want if w[1]) and root == [w for w in want if not w[1]]


def test_query_against_sql_and_plain_nodes(spark):
    sf = "/root/testdata/sf0.001"
    got = pt.query(spark, sf).toPandas()
    assert compare(got, connect(sf).execute(pt.SQL).df()) == ""
    own: dict = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own.setdefault(r["conv_id"], []).append(((r["role"] or "", r["text"] or ""), len(r["text"] or "")))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    want = list(plain(made))
    assert len(want) == len(got)
    assert sorted(map(str, want)) == sorted(str((*(int(x) for x in r[:2]), None if r[2] != r[2] else int(r[2]), *(int(x) for x in r[3:7]), r[7])) for r in got[pt.OUT].itertuples(index=False))


def test_odd_rows(spark):
    rows = [(1, None, "user", "b"), (1, 0, None, None), (None, 0, "user", "x"), (2, 0, "", ""), (2, 0, "", ""), (3, 0, "user", "b"), (3, 1, "", ""), (4, 5, "us", "erb"), (5, 0, "user", "long " * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    got = {(r["conv_id"], r["depth"]): r for r in pt.trie(pt.conversations(df)).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (5, 1)}
    assert got[1, 0]["n_convs"] == 5 and got[1, 2]["n_convs"] == 2 and got[1, 0]["n_leaves"] == 4 and got[1, 0]["saved_tokens"] == 1
    assert pt.trie(pt.conversations(df.limit(0))).count() == 0
    # a conversation whose turns all give way to an absent base stays as a member of the root
    lone = spark.createDataFrame([(101, 0, "user", "x"), (103, 0, "user", "y")], df.schema.simpleString()[7:-1].replace(":", " ").replace("bigint", "long").split(",key")[0])
    assert {r["depth"]: r["n_convs"] for r in pt.trie(pt.rebuilt(pt.conversations(lone))).collect()}[0] == 2

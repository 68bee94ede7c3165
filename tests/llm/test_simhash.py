from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from kickframe.llm import simhash
from kickframe.llm.graph import components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(nodes, near):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint_and_classes(spark, odd_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        assert r["fp"] % 2**64 == plain_fingerprint(texts[r["doc_id"]]) or r["doc_id"] is None
    fps = {r["fp"] % 2**64 for r in got}
    roots = plain_classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    for r in got:
        own = [x["doc_id"] for x in got if roots[x["fp"] % 2**64] == roots[r["fp"] % 2**64] and x["doc_id"] is not None]
        assert r["component_id"] == min(own, default=None)


def planted(n, seed=5):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.add(x)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
    return sorted(out)


def test_links_lose_no_connection_with_split_keys(spark):
    hub = {0x0123456789ABCDEF ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    fps = sorted({*planted(120), *hub, 0, 1, 2**63})
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = plain_classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    for lanes in (64, 4096):  # small sub-blocks meet pairwise, large ones hold all
        roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(frame, lanes=lanes)).collect()}
        classes: dict = {}
        for f in fps:
            classes.setdefault(roots.get(f, f), set()).add(f)
        wanted: dict = {}
        for f in fps:
            wanted.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, 200, dtype=np.uint64)
    fps[50:120] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64))
    planes = simhash.planes_of(fps)
    for s in (1, 5, 63, 64, 65, 130):
        valid = np.zeros(planes.shape[1] * 64, bool)
        valid[: 200 - s] = True
        for radius in (0, 1, 2, 3):
            got = simhash.close_lanes(planes, np.packbits(valid, bitorder="little").view("<u8"), s, radius)
            want = [i for i in range(200 - s) if int(fps[i] ^ fps[i + s]).bit_count() <= radius]
            assert sorted(got.tolist()) == want


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_first(spark, odd_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    named = simhash.near_duplicates(odd_docs).where("doc_id = component_id").select("doc_id").distinct()
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in named.collect())
    assert simhash.keep_first(odd_docs.limit(0)).count() == 0
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    rows = [(None, "only text here"), (None, "only text here"), (None, "only TEXT here"), (3, "x"), (None, "x"), (None, None)]
    lone = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in simhash.keep_first(lone).collect()]
    assert sorted(kept, key=str) == sorted([(3, "x"), (None, "only text here"), (None, "")], key=str)


def test_keep_first_of_one_id_on_several_texts(spark):
    a, b, c = "alpha beta gamma delta epsilon zeta", "one two three four five six seven", "rot gruen blau gelb schwarz weiss"
    rows = [(5, a), (5, b), (9, b), (2, c), (5, c), (5, a), (7, a), (2, c)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    # id 5 is the first of two groups; its copy of the third goes, whose first is id 2
    assert sorted(tuple(r) for r in kept.collect()) == sorted([(5, a), (5, b), (2, c)])

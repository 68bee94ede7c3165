from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from kickframe.llm import align
from kickframe.llm.bpe import BYTE_BPE, token_bytes, tokenizer_of


def plain(docs):
    """The contract, token by token."""
    a_bytes, b_bytes = token_bytes(BYTE_BPE), align.piece_bytes(align.MODEL)
    sp, tok = sentencepiece.SentencePieceProcessor(model_file=align.MODEL), tokenizer_of(BYTE_BPE, True)
    rows, links = [], []
    for i, text in docs:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[x] for x in a) != want or b"".join(b_bytes[x] for x in b) != want:
            rows.append((i, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a = np.cumsum([len(a_bytes[x]) for x in a]).tolist()
        ends_b = np.cumsum([len(b_bytes[x]) for x in b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups, x, y = [], 0, 0
        for e in both:
            ga, gb = [], []
            while x < len(a) and ends_a[x] <= e:
                ga.append(a[x])
                x += 1
            while y < len(b) and ends_b[y] <= e:
                gb.append(b[y])
                y += 1
            groups.append((ga, gb))
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((i, len(a), len(b), len(groups), hashlib.sha256(text.encode()).hexdigest()))
        links.append([(p, q) for k, p in enumerate(a) for m, q in enumerate(b) if ends_a[k] == ends_b[m]] if len(a) < 400 else [(p[-1], q[-1]) for p, q in groups])
    count = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, q), c in count.items():
        most[q] = max(most[q], c)
    return [(i, na, nb, ng, len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), sha) for (i, na, nb, ng, sha), own in zip(rows, links, strict=True)]


def fields(rows):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in rows), key=key)


@pytest.mark.parametrize("postings", [align.POSTINGS, 500])
def test_query_against_plain_alignment(spark, monkeypatch, postings):
    monkeypatch.setattr(align, "POSTINGS", postings)
    monkeypatch.setattr(align, "STEP", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert fields(align.scores(align.index(docs)).collect()) == fields(plain(docs.collect()))


def test_odd_rows(spark, odd_docs):
    odd = odd_docs.unionByName(spark.createDataFrame([(20, "a  b c", "fullwidth ａｂ"), (21, "▁x ▁", ""), (22, "<|endoftext|> </s> <0x41> <unk>", ""), (23, "a\u0000b ﬁ", "")], "doc_id long, text string, lang string"), allowMissingColumns=True)
    assert fields(align.scores(align.index(odd)).collect()) == fields(plain(odd.select("doc_id", "text").collect()))
    assert align.scores(align.index(odd.limit(0))).count() == 0


def test_bitmaps_give_back_every_posting():
    rng = np.random.default_rng(5)
    held, want = align.Postings(), {}
    for pair, n in ((3, 1), (7, 20_000), (9, 300), (11, align.DENSE), (12, align.DENSE + 1)):
        docs = np.sort(rng.choice(align.BLOCK, n, replace=False))
        times = rng.integers(1, 9, n) if pair != 9 else np.ones(n, np.int64)
        want[pair] = (docs.tolist(), times.tolist())
        half = n // 2
        for a, b in ((0, half), (half, n)):
            held.add(np.repeat(docs[a:b], times[a:b]), np.full(int(times[a:b].sum()), pair))
    made = held.planes()
    n = made["n_docs"].to_numpy()
    docs, times = align.unpacked(made["docs"], made["planes"], n)
    ends = np.cumsum(n)
    for k, pair in enumerate(made["pair"].to_pylist()):
        own = slice(ends[k] - n[k], ends[k])
        assert (docs[own].tolist(), times[own].tolist()) == want[pair]
        assert made["n_links"][k].as_py() == sum(want[pair][1])
    sliced = {c: made[c].slice(1, 3) for c in made}
    assert align.unpacked(sliced["docs"], sliced["planes"], n[1:4])[0].tolist() == docs[ends[0] : ends[3]].tolist()
    assert align.Postings().planes()["pair"].to_pylist() == []
    assert max(len(b) for b in made["docs"].to_pylist()) <= align.BLOCK // 8


def test_pair_counts(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["house", "river", "stones", "über"], k=6))) for i in range(40)], "doc_id long, text string")
    rows = align.index(docs)
    got = {(r["a"], r["b"]): (r["docs"], r["links"]) for r in align.pair_counts(rows).collect()}
    aligner, want, seen = align.Aligner(BYTE_BPE, align.MODEL), Counter(), defaultdict(set)
    for r in docs.collect():
        for _, a, b in aligner([r["text"]])[2].T.tolist():
            want[a, b] += 1
            seen[a, b].add(r["doc_id"])
    assert got == {k: (len(seen[k]), c) for k, c in want.items()}

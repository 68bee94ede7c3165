from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from kickframe.llm import pieces

HARD = ["", "a", " ", "  two  spaces ", "\n\n", "▁x ▁", "日本語テキスト😀\u0000é", "x" * 5000, "\t\r\n", "the" * 400, " ".join(["word***"] * 300)]


@pytest.fixture(scope="module")
def lattice():
    return pieces.lattice_of(pieces.MODEL, 1.0)


def coded(texts, lattice, seed=1):
    return pieces.encode_rows(texts, [pieces.seed_of(i, seed) for i in range(len(texts))], lattice)


def test_round_trip(lattice):
    assert [pieces.decode_row(g, lattice) for g in coded(HARD, lattice)] == HARD


def test_draws_do_not_hang_on_the_batch(lattice):
    texts = [f"{t} {i}" for i, t in enumerate(HARD * 3)]
    together = coded(texts, lattice)
    for i in (0, 5, 7, 20):
        alone = pieces.encode_rows([texts[i]], [pieces.seed_of(i, 1)], lattice)[0]
        assert np.array_equal(alone, together[i])


@pytest.mark.parametrize("word", ["then", "on", "aa,b"])
def test_samples_follow_the_weights_of_all_segmentations(lattice, word):
    ids = {lattice.bytes_of[i].decode(): i for i in lattice.log}
    text, found = " " + word, {}

    def walk(at, done, log):
        if at == len(text):
            found[tuple(done)] = log
            return
        for to in range(at + 1, len(text) + 1):
            if (i := ids.get(text[at:to])) is not None:
                walk(to, [*done, i], log + lattice.log[i])

    walk(0, [], 0.0)
    total, n = sum(map(math.exp, found.values())), 20000
    seen = Counter(tuple(g.tolist()) for g in coded([word] * n, lattice))
    assert set(seen) <= set(found)
    for s, log in found.items():
        p = math.exp(log) / total
        assert abs(seen[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_sums_in_logarithms_give_the_same(lattice, monkeypatch):
    texts = ["some plain words, and more of them"] * 5
    plain = coded(texts, lattice)
    monkeypatch.setattr(pieces, "PLAIN", 0)
    assert all(np.array_equal(a, b) for a, b in zip(plain, coded(texts, lattice), strict=True))


def test_collision_falls_back_to_the_characters(lattice, monkeypatch):
    texts = ["one two three two one"] * 2
    want = coded(texts, lattice)
    real = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **k: real(np.zeros_like(x), **k) if x.dtype == np.uint64 else real(x, **k))
    assert all(np.array_equal(a, b) for a, b in zip(want, coded(texts, lattice), strict=True))


def test_frame(spark, odd_docs):
    got = pieces.encode(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(r["lossless"] for r in rows)
    assert all((r["piece_ids"] is None) == (r["n_pieces"] == 0 and r["doc_id"] in (12, None)) for r in rows)
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(got).collect()}
    assert back == {(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()}
    assert pieces.encode(odd_docs.limit(0)).count() == 0


def test_a_step_of_rare_words_takes_little_memory(lattice):
    rng = random.Random(5)
    words = (" ".join("".join(rng.choices("aeioustnrl", k=rng.randint(5, 12))) for _ in range(200)) for _ in range(10_000))
    texts, held = [], 0
    while held < pieces.STEP:
        texts.append(next(words))
        held += len(texts[-1])
    tracemalloc.start()
    coded(texts, lattice)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6, peak

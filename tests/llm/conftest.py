from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns named like the operators' own."""
    rng = random.Random(3)
    words = "the of and house river stone licence permission granted cloud über été niño x1 a".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(40) for _ in range(6)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(10, base[0], "en", "s0"), (11, base[0], "en", None), (10, base[0], "en", "s0")]
    rows += [(12, None, None, "s1"), (13, "", "en", "s1"), (14, " \n\t ", "en", "s2"), (15, text(30_000), "en", "s2"), (16, "日本語 😀 ▁ \u0000 end", "ja", "s0")]
    rows += [(None, base[1], "en", "s0"), (None, None, None, None)]
    extra = [(*r, "u", 1, "count", "id", 2) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, fp string, key int, `b.c` string, tokens string, shard int")

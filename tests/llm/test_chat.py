from __future__ import annotations

import random

import numpy as np
import pytest
from check_queries import compare, connect

from kickframe.llm import chat

BITS = ["\\", "###", "</turn>", "\n", " ", "a", "n", ":", "é", "😀", "x y", "\\n", "#", "### Assistant:\n", "日本", "\\\\###", ""]


def some(rng, roles=("user", "assistant", "a:\nb", "", "\\")):
    return [(rng.choice(roles), "".join(rng.choices(BITS, k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 4))]


def test_formatting_is_reversible_and_the_mask_exact():
    rng = random.Random(7)
    for _ in range(2000):
        turns = some(rng)
        part = chat.format_part(turns)
        assert chat.parse(part.text) == turns
        assert part.loss == [t for r, t in turns if r == "assistant"]
        assert len(part.ids) == len(part.mask)


EDGES = ["", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\\", "\\ ", "\\\n", "###", "</turn>", "<", "'s", ":", "1", "a", "é", "😀"]


def test_no_masked_token_covers_template_text():
    tok = chat.tokenizer_of(chat.TOKENIZER)
    texts = [a + mid + b for a in EDGES for mid in ("", "hello", "\n") for b in EDGES]
    for at in range(0, len(texts), 50):
        turns = [t for text in texts[at : at + 50] for t in (("user", text), ("assistant", text))]
        part = chat.format_part(turns)
        assert chat.parse(part.text) == turns and part.loss == [t for r, t in turns if r == "assistant"]
        # what the masked ids decode to are the escaped texts, and nothing of the template
        masked = tok.decode([i for i, m in zip(part.ids, part.mask.tolist(), strict=True) if m], skip_special_tokens=False)
        assert masked == "".join(chat.escape(t) for r, t in turns if r == "assistant")


def test_parts_have_the_tokens_of_the_whole():
    rng = random.Random(8)
    for _ in range(500):
        turns = [*some(rng), *some(rng)]
        cut = rng.randint(1, len(turns) - 1)
        assert chat.format_part(turns[:cut]).ids + chat.format_part(turns[cut:]).ids == chat.format_part(turns).ids


def test_overlaps_equal_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cuts = np.unique(rng.integers(0, 60, 12))
        tokens = np.column_stack([cuts[:-1], cuts[1:]])
        edges = np.unique(rng.integers(0, 60, 8))
        spans = np.column_stack([edges[:-1:2], edges[1::2]]) if len(edges) % 2 == 0 else np.column_stack([edges[:-2:2], edges[1:-1:2]])
        number, hit = chat.overlaps(spans, tokens)
        want = [(k, s, max(a, x), min(b, y)) for s, (a, b) in enumerate(spans) for k, (x, y) in enumerate(tokens) if max(a, x) < min(b, y)]
        assert [(n, *h) for n, h in zip(number.tolist(), hit.tolist(), strict=True)] == want


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(chat.query(spark, sf).toPandas(), connect(sf).execute(chat.SQL).df()) == ""


def test_odd_rows_and_long_conversations(spark, monkeypatch):
    rows = [(1, 0, "user", None, "x"), (1, 1, None, "b", "x"), (None, 0, "assistant", "n", "x"), (2, None, "assistant", "", "x"), (3, 0, "assistant", "t", "x"), (3, 0, "assistant", "t", "x")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} " * 30_000, "x") for i in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = {r["conv_id"]: r for r in chat.summary(df).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 2, None: 1, 2: 1, 3: 2, 4: 6}
    assert got[4]["loss_chars"] == sum(len(r[3]) for r in rows if r[0] == 4 and r[2] == "assistant")
    assert chat.summary(df.limit(0)).count() == 0
    parts = chat.formatted(df).where("conv_id = 4").orderBy("part").collect()
    assert len(parts) > 1 and [p["part"] for p in parts] == list(range(len(parts)))
    assert chat.parse("".join(p["text"] for p in parts)) == [(r[2], r[3]) for r in rows if r[0] == 4]
    with pytest.raises(ValueError):
        chat.parse("not a turn")

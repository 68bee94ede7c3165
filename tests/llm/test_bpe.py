from __future__ import annotations

import random

from kickframe.llm.bpe import Encoder, token_bytes, tokenizer_of
from kickframe.llm.bpe import BYTE_BPE as PATH

BITS = [" ", "  ", "\n", "\t", "a", "'s", "'", "é", "日本", " b", "1", "12", " 3", "!", "\x1c", " ", "　", "<|endoftext|>", "😀", "ab", "x" * 60, " long" * 30]


def test_pieces_give_the_tokenizers_own_ids(monkeypatch):
    monkeypatch.setattr("kickframe.llm.bpe.HELD", 3000)
    rng = random.Random(1)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(4000)]
    for plain in (False, True):
        encode = Encoder(plain=plain)
        for k in range(0, len(texts), 500):
            part = texts[k : k + 500]
            want = [e.ids for e in tokenizer_of(PATH, plain).encode_batch(part, add_special_tokens=False)]
            ids, counts = encode(part)
            assert counts.tolist() == list(map(len, want))
            assert ids.tolist() == [i for w in want for i in w]


def test_token_bytes_spell_the_text():
    rng, spell = random.Random(2), token_bytes(PATH)
    for _ in range(300):
        text = "".join(rng.choices(BITS, k=rng.randint(0, 14)))
        assert b"".join(spell[i] for i in tokenizer_of(PATH, True).encode(text, add_special_tokens=False).ids) == text.encode()


def test_signs_and_lines_are_parts_of_their_own():
    rng = random.Random(3)
    bits = ["a", "Ω", "Ж", "ʰ", "²", "٣", "语", "'s", "'", ",", ".", "?!", ")", "\n", "\n", "\n\n", "\r\n", " ", " ", " ", " ", "͸", "ß", "12"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 16))) for _ in range(6000)]
    encode = Encoder()
    ids, counts = encode(texts)
    want = [e.ids for e in tokenizer_of(PATH).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    # a word is learnt once, whatever stands behind it
    encode.forget()
    encode(["x house, house.\nHouse house; house!\nhouse"])
    assert {k.strip() for k in encode.slots} == {"x", "house", "House", ",", ".", ";", "!", ""}

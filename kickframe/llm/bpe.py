"""Byte-level BPE ids of many texts: pieces that the tokenizer always separates are encoded once each and looked up after."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: A token of a byte-level vocabulary always begins at a space with a visible sign behind it, so texts may be cut there.
CUT = re.compile(r"(?= \S)")
#: A space with white space behind it, whichever kind.
WIDE = r" [\s\pZ\x0b\x1c-\x1f\x{85}]"
#: A line's end with white space beside it.
LOOSE_LINE = r"\n[\s\pZ\x0b\x1c-\x1f\x{85}]|[\s\pZ\x0b\x1c-\x1f\x{85}]\n"
#: Signs at the end of a piece that are tokens of their own when a letter or digit stands before them.
SIGNS = ".,;:!?"
#: Letters and digits of long standing at the end: the tokenizer's tables have them too.
LETTER = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{481}\x{48A}-\x{4FF}]$"
#: Pieces up to this many code points are remembered; longer ones are encoded wherever they occur.
SHORT = 48
#: Ids of remembered pieces held by a worker; beyond it the memory starts anew.
HELD = 3_000_000
#: Bytes of unknown pieces that go to the tokenizer as one text: of long texts a piece takes longer.
RUN = 4_000


@lru_cache(maxsize=4)
def tokenizer_of(path: str, plain: bool = False):
    """The tokenizer of a file. ``plain``: strings of special tokens inside a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain
    return made


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 signs for themselves, the rest from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id, special tokens by their own text."""
    made = tokenizer_of(path)
    of, special = byte_of(), made.get_added_tokens_decoder()
    out = [b""] * (max(made.get_vocab().values()) + 1)
    for token, i in made.get_vocab().items():
        out[i] = token.encode() if i in special else bytes(of[c] for c in token)
    return out


class Encoder:
    """ids of whole texts, equal to the tokenizer's own for each text."""

    def __init__(self, path: str = BYTE_BPE, plain: bool = False):
        self.tokenizer = tokenizer_of(path, plain)
        self.size = np.array([len(b) for b in token_bytes(path)], np.int64)
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.signs = "" if any(set(SIGNS) & set(t) for t in self.special) else SIGNS
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        # of the remembered pieces; the arrays have room at their ends
        self.n_ids = 0
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces_ids(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids laid end to end, count of each piece). Pieces that begin at a cut are run together and told apart by their bytes."""
        words = [k[1:] if k[:1] == " " else " " + k for k in keys]
        size = pc.binary_length(pa.array(words, pa.large_string())).to_numpy()
        loose = np.fromiter((k[:1] in {"", " "} for k in keys), bool, len(keys))
        tied = np.flatnonzero(~loose)
        run = np.cumsum(size[tied]) // RUN
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(tied)]
        order = np.concatenate([tied, np.flatnonzero(loose)])
        ordered = list(map(words.__getitem__, order.tolist()))
        got = [np.array(x, np.int32) for x in self._encode(["".join(ordered[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a] + ordered[len(tied) :])]
        flat = np.concatenate([np.zeros(0, np.int32), *got])
        # tokens never reach over a piece, so bytes tell where each piece ends among the ids
        ends = np.searchsorted(np.cumsum(self.size[flat]), np.cumsum(size[order]), side="right")
        counts, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        counts[order] = np.diff(ends, prepend=0)
        at[order] = ends - counts[order]
        return flat[_ranges(at, counts)], counts

    def _keys(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(keys of pieces, their numbers in the order of the texts, pieces of each text).

        A word stands for itself with the space before it; a key that begins with a space is the piece behind that space, one
        that begins with a line's end has no space before it. Where spaces meet other white space a text is cut sign by sign,
        with special tokens inside not at all.
        """
        odd, whole = pc.match_substring_regex(texts, WIDE).to_numpy(zero_copy_only=False), np.zeros(len(texts), bool)
        for token in self.special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = ~(odd | whole)
        tight = texts.filter(pa.array(plain))
        # a single line's end between signs is a token of its own
        tight = pc.if_else(pc.match_substring_regex(tight, LOOSE_LINE), tight, pc.replace_substring(tight, "\n", " \n"))
        lists = pc.split_pattern(tight, " ")
        counts, coded = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        number, head = np.array(coded.indices, np.int64), np.cumsum(counts) - counts
        apart = [" " + k for k in _strings(coded.dictionary.take(pa.array(number[head])))]
        number[head] = len(coded.dictionary) + np.arange(len(head))
        others = [[t] if w else CUT.split(t) for t, w in zip(texts.filter(pa.array(~plain)).to_pylist(), whole[~plain].tolist(), strict=True)]
        per_text = np.zeros(len(texts), np.int64)
        per_text[plain], per_text[~plain] = counts, [len(x) for x in others]
        if others:
            start, every = np.cumsum(per_text) - per_text, np.empty(int(per_text.sum()), np.int64)
            every[_ranges(start[plain], counts)] = number
            every[_ranges(start[~plain], per_text[~plain])] = len(coded.dictionary) + len(apart) + np.arange(int(per_text[~plain].sum()))
            apart, number = apart + [" " + p for pieces in others for p in pieces], every
        return pa.concat_arrays([coded.dictionary, pa.array(apart, pa.large_string())]), number, per_text

    def _parts(self, keys: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(keys of parts, their numbers in the order of the keys, parts of each key).

        The line's end before a word and the signs behind it are parts of their own.
        """
        stems = pc.ascii_rtrim(keys, characters=self.signs) if self.signs else keys
        behind = (pc.binary_length(keys).to_numpy() - pc.binary_length(stems).to_numpy()).astype(np.int64)
        cut = np.flatnonzero(behind)
        cut = cut[pc.match_substring_regex(stems.take(pa.array(cut)), LETTER).to_numpy(zero_copy_only=False)]
        apart = np.zeros(len(keys), np.int64)
        apart[cut] = 1
        coded = pc.if_else(pa.array(apart.astype(bool)), stems, keys).dictionary_encode()
        parts = _strings(coded.dictionary)
        for k in np.flatnonzero(pc.starts_with(coded.dictionary, "\n").to_numpy(zero_copy_only=False)).tolist():
            parts[k] = " " + parts[k][1:]
        n = len(parts)
        parts += [" " + k[-b:] for k, b in zip(_strings(keys.take(pa.array(cut))), behind[cut].tolist(), strict=True)]
        lines = pc.starts_with(keys, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        counts = 1 + lines + apart
        ends = np.cumsum(counts)
        order = np.full(int(counts.sum()), len(parts))
        order[ends - counts + lines] = coded.indices.to_numpy()
        order[ends[cut] - 1] = n + np.arange(len(cut))
        return [*parts, " \n"], order, counts

    def _known(self, parts: list[str]) -> tuple[np.ndarray, list[str]]:
        """(slot of every part, pieces to be forgotten after use). Unknown parts are encoded, short ones before long ones."""
        slot = np.fromiter(map(self.slots.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(slot < 0)
        if not len(new):
            return slot, []
        unknown = list(map(parts.__getitem__, new.tolist()))
        fresh = list(dict.fromkeys(unknown))
        long = [k for k in fresh if len(k) > SHORT]
        if long:
            fresh = [k for k in fresh if len(k) <= SHORT] + long
        ids, counts = self._pieces_ids(fresh)
        n = len(self.slots)
        self.starts = _laid(self.starts, n, self.n_ids + np.cumsum(counts) - counts)
        self.counts = _laid(self.counts, n, counts)
        self.ids = _laid(self.ids, self.n_ids, ids)
        self.n_ids += len(ids)
        index = dict(zip(fresh, range(n, n + len(fresh)), strict=True))
        self.slots.update(index)
        slot[new] = np.fromiter(map(index.__getitem__, unknown), np.int64, len(new))
        return slot, long

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, count of each text)."""
        if self.n_ids > HELD:
            self.forget()
        keys, number, per_text = self._keys(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        parts, order, n_parts = self._parts(keys)
        slot, long = self._known(parts)
        slot = slot[order]
        # ids of every key first, then of the texts
        counts = self.counts[slot].astype(np.int64)
        key_ids = self.ids[_ranges(self.starts[slot], counts)]
        sums, edge = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(n_parts)
        starts = sums[edge - n_parts]
        counts = (sums[edge] - starts)[number]
        out = key_ids[_ranges(starts[number], counts)]
        for key in long:
            self.n_ids -= int(self.counts[self.slots.pop(key)])
        sums, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(per_text)
        return out, sums[ends] - sums[ends - per_text]


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _laid(into: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``into`` with ``more`` behind its first ``n`` items, and room for the next ones."""
    if n + len(more) > len(into):
        into = np.concatenate([into[:n], np.zeros(n // 2 + len(more), into.dtype)])
    into[n : n + len(more)] = more
    return into


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range, laid end to end."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


@lru_cache(maxsize=2)
def encoder_of(path: str = BYTE_BPE, plain: bool = False) -> Encoder:
    """The encoder of a worker process; tasks that follow each other there share its memory of pieces."""
    return Encoder(path, plain)

"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kickframe.llm.common import col, map_batches, table

# Wording of public licence notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
}
# The words that tell a licence from its kin. Of each group one run of words has to stand in a match (or end on the word behind it).
KEYS = {
    "MIT-line": (("mit license", "mit licence"),),
    "Apache-2.0-line": (("apache license", "apache licence"), ("2 0", "version 2", "v2", "license 2", "licence 2")),
    "GPL-3.0-line": (("gnu general public license", "gnu general public licence"), ("version 3", "v3", "v 3", "license 3", "licence 3")),
    "CC-BY-NC-4.0-line": (("by nc 4", "by nc v4", "by nc version 4"),),
}
# Runs of words that name another licence than the long template whose other words match.
UNLIKE = {
    "Apache-2.0": ("version 1 0", "version 1 1", "license 1 0", "license 1 1"),
    "GPL-3.0": ("lesser general public", "affero general public", "library general public", "version 1", "version 2", "license 2"),
    "MPL-2.0": ("v 1 0", "v 1 1", "version 1 0", "version 1 1", "mpl 1 0", "mpl 1 1"),
}
#: Words of a template up to which every shared pair of words makes a candidate: one changed word may leave no run of GRAM.
SHORT = 12
#: Words in a fingerprint and fingerprints in a window: any shared run of GRAM + WINDOW - 1 words is found.
GRAM, WINDOW = 3, 2
#: Half the width of the alignment band: words left out or put in that a match may have, at most half of the template's.
BAND = 16
#: Least share of a template's words that a match has to cover.
COVERAGE = 0.8
WORD = re.compile(r"\w+")
NONE = (1 << 64) - 1
#: A pair of words as one number: the first word's times this, and the second's.
PAIR = 1 << 31


@dataclass
class Index:
    """Templates as word numbers, their winnowed fingerprints with places, the word pairs of short ones, and key words."""

    names: list[str]
    words: dict[str, int]
    templates: list[list[int]]
    posting: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    pairs: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    keys: list[tuple[tuple[str, ...], ...]] = field(default_factory=list)
    unlike: list[tuple[str, ...]] = field(default_factory=list)


def grams(ids: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM word numbers; NONE, the largest, for one that has a word of no template."""
    if len(ids) < GRAM:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(ids) - GRAM + 1, np.uint64)
        known = np.ones(len(out), bool)
        for k in range(GRAM):
            part = ids[k : k + len(out)]
            known &= part > 0
            out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.where(known, out, np.uint64(NONE))


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the chosen fingerprints: the rightmost least hash of every window of WINDOW hashes."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    if n <= WINDOW:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    wins = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    place = np.arange(len(wins)) + WINDOW - 1 - np.argmin(wins[:, ::-1], axis=1)
    return np.unique(place)


def build(templates: dict[str, str]) -> Index:
    """``KEYS`` and ``UNLIKE`` hold for the templates of this module, not for others of the same name."""
    words: dict[str, int] = {}
    tokens = [[words.setdefault(w, len(words) + 1) for w in WORD.findall(t.lower())] for t in templates.values()]
    index = Index(list(templates), words, tokens)
    for k, ids in enumerate(tokens):
        if len(ids) < GRAM + WINDOW - 1:
            raise ValueError(f"template {index.names[k]} has fewer than {GRAM + WINDOW - 1} words")
        hashes = grams(np.array(ids))
        for p in winnow(hashes).tolist():
            index.posting[int(hashes[p])].append((k, p))
        for p in range(len(ids) - 1 if len(ids) <= SHORT else 0):
            index.pairs[ids[p] * PAIR + ids[p + 1]].append((k, p))
        own = TEMPLATES.get(index.names[k]) == templates[index.names[k]]
        index.keys.append(KEYS.get(index.names[k], ()) if own else ())
        index.unlike.append(UNLIKE.get(index.names[k], ()) if own else ())
    return index


def common(template: list[int], doc: list[int]) -> int:
    """Length of the longest common subsequence, by bits: a bound on any banded alignment."""
    places: dict[int, int] = {}
    for i, word in enumerate(template):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(template)) - 1
    row = full
    for word in doc:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(template) - row.bit_count()


def align(template: list[int], doc: list[int], at: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence of a template with the document words near the diagonal that puts its start at ``at``.

    (matched words, first document word, behind the last). Only cells up to ``band`` words off the diagonal are filled; of
    equal lengths the match that ends, then starts, nearest is taken.
    """
    width = 2 * band + 1
    # a cell is (matches, -start, end) so that larger is better; cell k of row i stands for document word at + i + k - band
    row = [(0, 0, 0)] * (width + 1)
    best = (0, 0, 0)
    for i, word in enumerate(template):
        new = [(0, 0, 0)] * (width + 1)
        for k in range(width):
            j = at + i + k - band
            cell = max(row[k + 1], new[k - 1] if k else (0, 0, 0), key=_further)
            if 0 <= j < len(doc) and doc[j] == word:
                n, start, _ = row[k]
                hit = (n + 1, start if n else -j, j + 1)
                cell = max(cell, hit, key=_further)
                if _better(hit) > _better(best):
                    best = hit
            new[k] = cell
        row = new
    return best[0], -best[1], best[2]


def matches_of(template: list[int], doc: list[int], hits: list[tuple[int, int]], need: float, fits, band: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(matched words, first word, behind the last) of every match of one template in words ``lo`` to ``hi`` near its ``hits`` (diagonal, place).

    Diagonals within the band of the first are tried together. After a match the words before and behind it are searched
    again by the hits that lie there, until no diagonal reaches ``need``.
    """
    hits = sorted(h for h in hits if lo <= h[1] < hi)
    groups, at = [], 0
    for i in range(1, len(hits) + 1):
        if i == len(hits) or hits[i][0] - hits[at][0] > band:
            groups.append(hits[at:i])
            at = i
    for group in groups:
        todo = [(lo, hi, group)]
        while todo:
            first, end, left = todo.pop()
            for d in sorted({d for d, _ in left}):
                low, high = max(first, d - band), min(end, d + len(template) + band)
                part = doc[low:high] if low < high else []
                if common(template, part) < need:
                    continue
                n, a, b = align(template, part, d - low, band)
                if n >= need and fits(a + low, b + low):
                    a, b = a + low, b + low
                    yield n, a, b
                    todo.append((first, a, [h for h in left if h[1] < a]))
                    todo.append((b, end, [h for h in left if h[1] >= b]))
                    break


def _further(cell: tuple[int, int, int]) -> tuple[int, int, int]:
    return cell[0], -cell[1], -cell[2]  # more words, then the later start: what follows makes the tightest span of it


def _better(cell: tuple[int, int, int]) -> tuple[int, int, int]:
    return cell[0], -cell[1] - cell[2], -cell[2]  # more words, then the tighter span, then the earlier


def scan(text: str, index: Index, coverage: float = COVERAGE, band: int = BAND) -> list[tuple[str, int, float, int, int]]:
    """(template, matched words, coverage, start, end) of every match, spans in code points, in order of start.

    Fingerprint hits, and for short templates word pairs, name (template, diagonal); a match covers enough of the template
    and has its key words. Of matches that overlap in the text, the one with more words stays, so that a notice counts once
    and not for its shorter forms.
    """
    low = text.lower()
    if len(low) != len(text):  # a few letters change length; they keep their places this way
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    known = index.words.get
    found = WORD.findall(low)
    ids = np.fromiter((known(w, 0) for w in found), np.int32, len(found))
    # only runs of template words can hold a fingerprint or a pair
    if len(ids) < 2 or not ((ids[:-1] > 0) & (ids[1:] > 0)).any():
        return []
    votes: dict[int, set[tuple[int, int]]] = defaultdict(set)
    hashes = grams(ids)
    picked = winnow(hashes)
    picked = picked[hashes[picked] != np.uint64(NONE)]
    for p, h in zip(picked.tolist(), hashes[picked].tolist(), strict=True):
        for k, q in index.posting.get(h, ()):
            votes[k].add((p - q, p))
    pairs = ids[:-1].astype(np.int64) * PAIR + ids[1:]
    for p in np.flatnonzero(np.isin(pairs, list(index.pairs))).tolist() if index.pairs else ():
        for k, q in index.pairs[int(pairs[p])]:
            votes[k].add((p - q, p))
    doc = ids.tolist()

    def search(k: int, lo: int, hi: int) -> Iterator[tuple]:
        template, groups, others = index.templates[k], index.keys[k], index.unlike[k]

        def fits(a: int, b: int) -> bool:
            span = f" {' '.join(found[a : b + 1])} "
            return all(any(f" {run} " in span for run in runs) for runs in groups) and not any(f" {run} " in span for run in others)

        for n, a, b in matches_of(template, doc, list(votes[k]), coverage * len(template), fits, min(band, len(template) // 2), lo, hi):
            yield -n, a, b, index.names[k], k

    queue = [m for k in votes for m in search(k, 0, len(doc))]
    seen, taken, out = set(queue), [], []
    heapq.heapify(queue)
    if queue:
        spans = [m.span() for m in WORD.finditer(low)]
    while queue:
        n, a, b, name, k = heapq.heappop(queue)
        at = bisect.bisect_left(taken, (b, 0))
        first = at
        while first and taken[first - 1][1] > a:
            first -= 1
        if first < at:
            # some of its words are another's: what is free there may still hold a match
            ends = [0 if not first else taken[first - 1][1], *(y for _, y in taken[first:at])]
            starts = [*(x for x, _ in taken[first:at]), taken[at][0] if at < len(taken) else len(doc)]
            for m in (m for x, y in zip(ends, starts, strict=True) for m in search(k, x, y)):
                if m not in seen:
                    seen.add(m)
                    heapq.heappush(queue, m)
            continue
        bisect.insort(taken, (a, b))
        out.append((name, -n, -n / len(index.templates[k]), spans[a][0], spans[b - 1][1]))
    return sorted(out, key=lambda m: (m[3], m[4]))


@lru_cache(maxsize=4)
def _index(items: tuple[tuple[str, str], ...]) -> Index:
    return build(dict(items))


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, words, coverage, start, end) of every match in every whole text; documents without one give no row.

    The index of the templates is as large as they are and goes with the code. Null and empty texts match nothing;
    a null id stays null; rows that repeat give their matches each; the table may be empty.
    """
    items = tuple((templates or TEMPLATES).items())
    build(dict(items))  # wrong templates fail here, not in a task

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index, texts = _index(items), batch.column(1)
        at, rows = [], []
        for i in range(len(texts)):
            for m in scan(texts[i].as_py() or "", index, coverage):
                at.append(i)
                rows.append(m)
        if rows:
            name, words, share, start, end = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(name), pa.array(words, pa.int32()), pa.array(share), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                ["doc_id", "license", "words", "coverage", "start", "end"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")), work, f"doc_id {kind}, license string, words int, coverage double, start long, end long")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))

from __future__ import annotations

import random

import pytest

from kickframe.llm import licenses


@pytest.fixture(scope="module")
def index():
    return licenses.build(licenses.TEMPLATES)


def test_every_template_is_found_with_its_span(index):
    for name, text in licenses.TEMPLATES.items():
        got = licenses.scan(f"İ some words before. {text} And words after.", index)
        assert [m[0] for m in got] == [name] and got[0][2] == 1.0
        span = f"İ some words before. {text} And words after."[got[0][3] : got[0][4]]
        assert span.split()[0] == text.split()[0] and text.startswith(span) and len(text) - len(span) <= 2


def test_changed_words_and_partial_templates(index):
    rng = random.Random(2)
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-2-Clause"):
        words = licenses.TEMPLATES[name].split()
        for _ in range(20):
            changed = list(words)
            for _ in range(len(words) // 15):
                k = rng.randrange(len(changed))
                changed[k : k + 1] = rng.choice([[], ["zzz"], [changed[k], "zzz"]])
            got = [m for m in licenses.scan("x y " + " ".join(changed) + " z", index) if m[0] == name]
            assert len(got) == 1 and 0.8 <= got[0][2] <= 1.0
        assert not [m for m in licenses.scan(" ".join(words[: len(words) // 2]), index) if m[0] == name]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_full_one_inside_the_band():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randint(1, 5) for _ in range(rng.randint(5, 12))]
        b = [rng.randint(1, 5) for _ in range(rng.randint(5, 12))]
        n, start, end = licenses.align(a, b, 0, band=20)
        assert n == longest_common(a, b)
        if n:
            assert longest_common(a, b[start:end]) == n and b[start] in a and b[end - 1] in a


def test_winnowing_finds_shared_runs():
    import numpy as np

    rng = np.random.default_rng(1)
    need = licenses.GRAM + licenses.WINDOW - 1
    for _ in range(200):
        shared = rng.integers(1, 50, need)
        picked = []
        for _ in range(2):
            ids = np.concatenate([rng.integers(1, 50, rng.integers(0, 9)), shared, rng.integers(1, 50, rng.integers(0, 9))])
            h = licenses.grams(ids)
            picked.append(set(h[licenses.winnow(h)].tolist()))
        assert picked[0] & picked[1]


def test_frame(spark, odd_docs):
    assert licenses.scan_licenses(odd_docs).count() == 0
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "x Released under the MIT License."), (2, None)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["start"], r["end"]) for r in got) == [(0, "MIT-line", 2, 32), (1, "MIT-line", 0, 30), (1, "MIT-line", 0, 30)]
    with pytest.raises(ValueError):
        licenses.scan_licenses(odd_docs, {"short": "two words"})


def test_repeated_notices_are_all_found(index):
    for name, text in licenses.TEMPLATES.items():
        for times in (2, 3, 4):
            whole = " ".join([text] * times)
            got = licenses.scan(whole, index)
            assert [m[0] for m in got] == [name] * times
            assert [m[3] for m in got] == [k * (len(text) + 1) for k in range(times)]
    mixed = "Released under the MIT License. Licensed under CC BY-NC 4.0. Released under the MIT License. Released under an MIT License"
    assert [m[0] for m in licenses.scan(mixed, index)] == ["MIT-line", "CC-BY-NC-4.0-line", "MIT-line", "MIT-line"]


def test_words_that_tell_licences_apart(index):
    gpl = "This work is licensed under the GNU {}General Public License, {}."
    for text in (
        "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC 3.0.", "Released under the BSD License.", "Licensed under the Apache License, Version 1.1.",
        gpl.format("", "version 2"), gpl.format("Lesser ", "version 3"), gpl.format("Affero ", "version 3"), licenses.TEMPLATES["GPL-3.0"].replace("version 3", "version 2"),
    ):
        assert licenses.scan(f"See here: {text} More words.", index) == [], text
    for text, name in (("Released under an MIT License", "MIT-line"), (gpl.format("", "version 3"), "GPL-3.0-line"), (gpl.format("", "v3"), "GPL-3.0-line"), ("Licensed under the Apache License 2.0", "Apache-2.0-line")):
        assert [m[0] for m in licenses.scan(f"See here: {text} of more words.", index)] == [name], text


def test_common_by_bits_is_the_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 80))] for _ in range(2))
        assert licenses.common(a, b) == longest_common(a, b)

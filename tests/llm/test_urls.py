from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from kickframe.llm import urls

CASES = {
    "http://A.Example.NET/en/1?x=/q": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "https://x.net/": ("x.net", "/", "net/", "block"),
    "https://x.net": ("x.net", "", None, None),
    "https://net?p=/": ("net", "", None, None),
    "ftp://b.example.com/de/#f/": ("b.example.com", "/de/", "example.com/de/", "block"),
    "ftp://bexample.com/de/": ("bexample.com", "/de/", None, None),
    "http://org/fr/a/://b": ("org", "/fr/a/://b", "org/fr/", "allow"),
    "no scheme/net/": ("", "", None, None),
    None: ("", "", None, None),
    "http:///path": ("", "/path", None, None),
    "a://ÄX.org/Fr/": ("Äx.org", "/Fr/", None, None),
    "http://evil\n.net/": ("evil\n.net", "/", "net/", "block"),
}


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "__url string")
    host, path = urls.split_url(F.col("__url"))
    rule, verdict = urls.match_rules(F.col("h"), F.col("p"))
    got = {r["__url"]: (r["h"], r["p"], r["r"], r["v"]) for r in df.select("__url", host.alias("h"), path.alias("p")).select("*", rule.alias("r"), verdict.alias("v")).collect()}
    assert got == CASES


def test_viterbi_equals_all_splits():
    counts = {"a": 5, "ab": 9, "abc": 2, "b": 4, "bc": 8, "c": 3, "cab": 1}
    total = 100
    weight = lambda w: math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10)
    for n in range(1, 7):
        for letters in itertools.product("abx", repeat=n):
            text = "".join(letters)
            found = {(i, k): counts[text[i : i + k]] for i in range(n) for k in range(1, n - i + 1) if text[i : i + k] in counts}
            got = urls.viterbi(text, found, total)
            splits = ([text[a:b] for a, b in zip((0, *c), (*c, n), strict=True)] for r in range(n) for c in itertools.combinations(range(1, n), r))
            best = max(sum(map(weight, s)) for s in splits)
            assert "".join(got) == text and math.isclose(sum(map(weight, got)), best)


@pytest.fixture(scope="module")
def pages(spark):
    good = [(i, f"https://www.riverstone{i % 5}.org/en/{i}", "<p>river and stone and river bridge</p>", 1) for i in range(200)]
    bad = [(1000 + i, f"https://cheappills.example.com/buy/{i}", "<b>cheap pills</b>", 1) for i in range(20)]
    odd = [(None, None, None, 1), (5, "http://bridgestone.org/", None, 1), (5, "http://bridgestone.org/", None, 1), (6, "", "", 1), (7, "x://" + "a" * 3000 + "/p", "", 1)]
    return spark.createDataFrame([*good, *bad, *odd], "page_id long, url string, html string, host int")


def test_joined_names_are_split_and_scored(spark, pages):
    got = urls.judge(pages).collect()
    assert len(got) == pages.count()
    by = {(r["host"], r["host_words"], r["verdict"]) for r in got}
    assert ("cheappills.example.com", "cheap pills example com", "block") in by
    assert ("bridgestone.org", "bridge stone org", "allow") in by
    assert ("www.riverstone1.org", "www river stone org", "allow") in by
    assert {r["verdict"] for r in got if r["host"] == ""} == {"allow"}
    assert urls.judge(pages.limit(0)).count() == 0


def test_bayes_sums(spark):
    rows = spark.createDataFrame([([1, 2], True), ([2], False), ([3, 2], False)], "buckets array<int>, bad boolean")
    m = urls.train(rows)
    a = urls.SMOOTH
    bad, good = {1: 1 + a, 2: 1 + a, 3: a}, {1: a, 2: 2 + a, 3: 1 + a}
    for b in (1, 2, 3):
        assert math.isclose(m.weights[b], math.log(bad[b] / sum(bad.values())) - math.log(good[b] / sum(good.values())))
    assert m.weights[77] == 0 and math.isclose(m.prior, math.log(2 / 3))


def test_tokens_are_exact_in_a_large_vocabulary(spark):
    n = 70_000  # more than any table of hashed buckets of 16 bits can keep apart
    pages = spark.range(2 * n).select(
        F.col("id").alias("page_id"),
        F.concat(F.when(F.col("id") < n, F.lit("http://spam.com/")).otherwise(F.lit("http://river.com/")), F.translate(F.conv(F.col("id").cast("string"), 10, 16), "0123456789ABCDEF", "ghijklmnopqrstuv")).alias("url"),
        F.lit(None).cast("string").alias("html"),
    )
    got = urls.judge(pages, rules=()).where("host <> ''").groupBy("host", "score", "verdict").count().collect()
    a = urls.SMOOTH
    bad, good = [n * 3 + (2 * n + 3) * a] * 2  # h:spam or h:river, h:com and one path token a page
    weight = lambda x, y: math.log((x + a) / bad) - math.log((y + a) / good)
    want = weight(n, 0) + weight(n, n) + weight(1, 0)
    assert {(r["host"], r["verdict"], r["count"]) for r in got} == {("spam.com", "block", n), ("river.com", "allow", n)}
    assert all(abs(abs(r["score"]) - want) < 1e-5 for r in got)

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import functions as F

from kickframe.llm import spotsigs
from kickframe.session import shared_dir


def spots(text):
    """The (anchor, chain) set of a text, in plain Python."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    pairs = list(zip([*words, None], ["^", *words], strict=True))
    content = [(w, p) for w, p in pairs if w is None or w not in spotsigs.ANCHORS]
    return {(p, w, content[i + 1][0] if i + 1 < len(content) else None) for i, (w, p) in enumerate(content) if p == "^" or p in spotsigs.ANCHORS}


def near(a, b):
    value = len(a & b) / len(a | b)
    return value if value >= spotsigs.FLOOR else 0.0


def test_edit_check_against_plain_python(spark, odd_docs):
    docs = odd_docs.where("doc_id IS NOT NULL")
    got = sorted(spotsigs.edit_check(docs).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert len(got) == len(rows)
    for k, (r, (i, text)) in enumerate(zip(got, rows, strict=True)):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - near(spots(text), spots(edited))) < 1e-12 and abs(r["near_next"] - near(spots(text), spots(after))) < 1e-12
        assert len(r["fingerprint"].split()) == len(spots(text)) and len(r["edited_fingerprint"].split()) == len(spots(edited))


def test_runs_meet_over_gaps_and_at_the_end(spark):
    ids = [*range(0, 40), *range(5000, 5003), 100_000, 100_001, 2_000_000]
    docs = spark.createDataFrame([(i, f"the text number {i}") for i in ids], "id long, text string")
    for run in (2, 5, 1000):
        got = {r["id"]: r["after"] for r in spotsigs.with_next(docs, run).collect()}
        assert got == {i: f"the text number {ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_runs_are_cut_by_rows_not_by_the_range_of_ids(spark):
    ids = [*range(300), *range(10**6, 10**6 + 300), 10**18, -(10**17)]
    rows = [(i, f"text {i}") for i in ids] + [(None, f"none {i}") for i in range(100)] + [(7, f"again {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    sizes = [r["count"] for r in spotsigs.dealt_runs(df, 20).where("id IS NOT NULL AND id <> 7").groupBy("run").count().collect()]
    assert max(sizes) <= 60 and len(sizes) >= 15
    full = sorted(((i is None, i or 0, t) for i, t in rows if i is not None))
    got = sorted(((r["id"], r["text"]), r["after"]) for r in spotsigs.with_next(df, 20).where("id IS NOT NULL").collect())
    assert [g[0] for g in got] == [(i, t) for _, i, t in full]
    assert [g[1] for g in got[:-1]] == [t for _, _, t in full[1:]] and got[-1][1].startswith("none")
    nothing = df.where("id IS NULL")
    assert sorted(r["after"] for r in spotsigs.with_next(nothing, 20).collect()) == sorted(r["text"] for r in nothing.collect())


def test_equal_texts_single_rows_and_nulls(spark, odd_docs):
    got = spotsigs.edit_check(odd_docs).collect()
    assert len(got) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    by = {}
    for r in got:
        if r["doc_id"] is not None:
            by.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    one = spotsigs.edit_check(spark.createDataFrame([(5, "the only text")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"the only text"[:7] + b"the on").hexdigest()
    assert spotsigs.edit_check(odd_docs.limit(0)).count() == 0


def test_long_runs_of_common_words(spark):
    df = spark.createDataFrame([(1, "der " * 60_000 + "haus"), (2, "x")], "doc_id long, text string")
    assert spotsigs.edit_check(df).count() == 2


def test_no_python_on_the_path(spark, odd_docs):
    plan = spotsigs.edit_check(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pruning_by_length_is_below_the_floor(spark):
    sets = spark.createDataFrame([([*range(n)], [*range(m)]) for n in (1, 3, 50, 500) for m in (1, 3, 50, 500)], "a array<long>, b array<long>")
    for r in sets.select("a", "b", spotsigs.likeness(F.col("a"), F.col("b"), 0.05).alias("x")).collect():
        exact = min(len(r["a"]), len(r["b"])) / max(len(r["a"]), len(r["b"]))
        assert abs(r["x"] - (exact if exact >= 0.05 else 0.0)) < 1e-12


def test_stretches_without_common_words_are_fingerprinted(spark):
    prose = "the house of stone " * 5
    lists = [" | ".join(f"{x}{i}" for i in range(60)) for x in "pq"]
    texts = ["alpha beta " + " ".join(f"w{i}" for i in range(12)), "alpha beta " + " ".join(f"v{i}" for i in range(12)), prose + lists[0], prose + lists[1], "spam " * 50, "spam " * 50 + "egg " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spotsigs.edit_check(rows).orderBy("doc_id").collect()
    assert len({r["fingerprint"] for r in got}) == len(texts)
    assert got[0]["near_next"] < 0.2 and got[2]["near_next"] < 0.2  # only what stands before the list is shared
    assert got[2]["near_edited"] < 0.9  # half of the text is another's
    # inside ordinary prose nothing is added
    short = spotsigs.with_signatures(spark.createDataFrame([(prose,)], "text string"), "text", "s").first()["s"]
    assert len(short) == len(spots(prose))


def test_small_likeness_is_reported(spark):
    texts = [" ".join(f"the a{i}" for i in range(300)) + " the shared word the", "of b0 c0 the shared word the " + " ".join(f"of b{i}" for i in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spotsigs.edit_check(rows).orderBy("doc_id").first()["near_next"]
    a, b = map(spots, texts)
    assert 0 < len(a & b) / len(a | b) < 0.01
    assert abs(got - len(a & b) / len(a | b)) < 1e-12


def test_runs_are_cut_without_a_copy_of_the_texts(spark):
    docs = spark.range(200).select("id", F.concat(F.lit("the text number "), F.col("id")).alias("text"))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert spotsigs.with_next(docs, 20).count() == 200
    assert set(folder.iterdir()) == before

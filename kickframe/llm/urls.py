"""URL filters: rules first, else naive Bayes over host words found by unigram Viterbi and over path tokens."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.llm.common import col, settle, table

# Rules of the query as (verdict, host and path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Words that mark a host as unwanted. They label the training rows; other words are learnt from those rows.
SEEDS = """ads ad track tracker spam farm casino win bet bets betting poker slots adult porn xxx sex cams escort cheap pills pharma
viagra cialis warez crack keygen torrent phish malware clickbait lottery jackpot replica payday loans""".split()
#: Count that a seed word has at least in the dictionary.
SEED_COUNT = 20
#: Longest dictionary word.
WORD = 24
#: Added to each token count.
SMOOTH = 0.1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Bayes:
    """Log odds (block over allow) of the classes and of each token; a token that training never saw says nothing."""

    prior: float
    weights: dict


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Null, or without "://": both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains under its path prefix."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def dictionary(pages: DataFrame, html_col: str, parts: DataFrame) -> DataFrame:
    """(word, n): unigram counts of the pages' visible words, the parts of host names between dots and hyphens, and the seeds."""
    shown = F.regexp_replace(F.lower(F.coalesce(col(html_col).cast("string"), F.lit(""))), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.split(shown, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(1, WORD))
    seeds = pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in SEEDS], "word string, n long")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    # a part is no evidence that it is one word, but short ones are words of their own where hyphens set them off
    own = parts.where("set_off").select(F.col("part").alias("word"), F.lit(1).cast("long").alias("n"))
    return counted.unionAll(seeds).unionAll(own).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(text: str, found: dict[tuple[int, int], int], total: int) -> list[str]:
    """Best split of ``text`` under word frequencies; an unknown word of n letters has the weight 10 / (total * 10^n)."""
    best = [0.0] + [-math.inf] * len(text)
    back = [0] * (len(text) + 1)
    for i in range(1, len(text) + 1):
        for n in range(1, min(i, WORD) + 1):
            seen = found.get((i - n, n))
            gain = math.log(seen / total) if seen else math.log(10 / total) - n * math.log(10)
            if best[i - n] + gain > best[i]:
                best[i], back[i] = best[i - n] + gain, i - n
    words, at = [], len(text)
    while at:
        words.append(text[back[at] : at])
        at = back[at]
    return words[::-1]


def segment_hosts(pages: DataFrame, html_col: str) -> DataFrame:
    """(host, host_words) of the distinct hosts of ``pages`` (host, html).

    Parts of host names are looked up by a join of their substrings with the dictionary, which may be of any size; the
    matches of one part, at most its length times WORD, are split in one row.
    """
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages")).where("host <> ''")
    labels = hosts.select("host", F.posexplode(F.split("host", r"\.")).alias("at", "label"))
    parts = settle(labels.select("host", "at", (F.size(F.split("label", "-")) > 1).alias("set_off"), F.posexplode(F.split("label", r"[^\p{L}]+")).alias("sub", "part")).where("part <> ''"))
    words = dictionary(pages, html_col, parts)
    words = settle(words)
    total = words.agg(F.sum("n")).first()[0] or 1
    # the distinct parts, their substrings, and those the dictionary has
    subs = parts.select("part").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.length("part") - 1)))
    subs = subs.withColumn("n", F.explode(F.expr(f"sequence(1, least({WORD}, length(part) - i))"))).select("part", "i", "n", F.expr("substring(part, i + 1, n)").alias("word"))
    seen = subs.join(words.withColumnRenamed("n", "count"), "word").groupBy("part").agg(F.collect_list(F.struct("i", "n", "count")).alias("found"))
    known = parts.select("part").distinct().join(seen, "part", "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [viterbi(p, {(x["i"], x["n"]): x["count"] for x in f or ()}, total) for p, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.string()))], ["part", "words"])

    cut = known.select("part", "found").mapInArrow(split, "part string, words array<string>")
    ordered = parts.join(cut, "part").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "sub", "words"))).alias("w"))
    return ordered.select("host", F.flatten("w.words").alias("host_words"))


def tokens(words: Column, path: Column) -> Column:
    """Distinct tokens of a url in order: host words, and path parts with numbers as one sign."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(path), r"\d+", "0"), r"[^\p{L}\p{N}]+"), lambda p: p != "")
    both = F.concat(F.transform(words, lambda w: F.concat(F.lit("h:"), w)), F.transform(parts, lambda p: F.concat(F.lit("p:"), p)))
    return F.array_sort(F.array_distinct(both))


def odds(bad: int, n: int) -> float:
    """Log odds of the classes."""
    return math.log((bad + 1) / (n - bad + 1))


def weigh(counts: DataFrame) -> DataFrame:
    """(token, weight) of multinomial naive Bayes from ``counts`` (token, bad, n) of distinct tokens. Two sums come to the driver."""
    x, y = F.col("bad") + SMOOTH, F.col("n") - F.col("bad") + SMOOTH
    sums = counts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count("*").alias("size")).first()
    bad, size = sums["bad"] or 0, sums["size"]
    good = (sums["n"] or 0) - bad
    return counts.select("token", (F.log(x / (bad + SMOOTH * size or 1)) - F.log(y / (good + SMOOTH * size or 1))).alias("weight"))


def train(rows: DataFrame) -> Bayes:
    """The model of ``rows`` (buckets, bad) as a local one, for small vocabularies; ``judge`` joins the weights instead."""
    sums = rows.agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n")).first()
    counts = rows.select(F.explode("buckets").alias("token"), "bad").groupBy("token").agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n"))
    return Bayes(odds(sums["bad"] or 0, sums["n"]), defaultdict(float, {r["token"]: r["weight"] for r in weigh(counts).collect()}))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, host_words, score) of every page. ``score``: log odds of block over allow.

    Null urls and those without "://" have empty host and path, and the prior alone decides. Ids may be null or repeat.
    Training rows are all pages, labelled by whether a seed word is among the host's words. A common host is counted before
    any shuffle, and its pages meet its words in a join that may be split. Tokens are exact: counts and weights are tables of
    any size, joined to the distinct token sets. An empty table gives no rows.
    """
    read = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("__url"), col(html_col).cast("string").alias("html"))
    host, path = split_url(F.col("__url"))
    read = read.select("page_id", host.alias("host"), path.alias("path"), "html")
    words = segment_hosts(read.select("host", "html"), "html")
    joined = read.select("page_id", "host", "path").join(words, "host", "left").withColumn("host_words", F.coalesce("host_words", F.array().cast("array<string>")))
    rows = settle(joined.withColumn("tokens", tokens(F.col("host_words"), F.col("path"))))
    # pages of equal tokens are one set; sets are counted before the shuffle and keep their number once they are written
    sets = rows.groupBy("tokens").agg(F.count("*").alias("pages"))
    sets = settle(sets.select("tokens", "pages", F.arrays_overlap("tokens", F.array(*(F.lit(f"h:{w}") for w in SEEDS))).cast("long").alias("bad"), F.monotonically_increasing_id().alias("set")))
    sums = sets.agg(F.sum(F.col("pages") * F.col("bad")).alias("bad"), F.sum("pages").alias("n")).first()
    prior = odds(sums["bad"] or 0, sums["n"] or 0)
    each = sets.select("set", "pages", "bad", F.explode("tokens").alias("token"))
    counts = settle(each.groupBy("token").agg(F.sum(F.col("pages") * F.col("bad")).alias("bad"), F.sum("pages").alias("n")))
    # weights are added in order, so that equal sets score alike in every run
    lists = each.select("set", "token").join(weigh(counts), "token").groupBy("set").agg(F.sort_array(F.collect_list("weight")).alias("w"))
    totals = sets.join(lists, "set", "left").select("tokens", (F.lit(prior) + F.aggregate(F.coalesce("w", F.array().cast("array<double>")), F.lit(0.0), lambda s, w: s + w)).alias("score"))
    scored = rows.join(totals, "tokens")
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.array_join("host_words", " ").alias("host_words"), F.round("score", 6).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

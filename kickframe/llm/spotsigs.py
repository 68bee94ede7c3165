"""SpotSigs fingerprints: chains of content words behind common-word anchors, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.llm.common import col, table
from kickframe.operators.ordered import RANKS, sliced

# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = sorted(set("""
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were
le la les de des du et un une est que qui dans en pour par sur pas ne au aux avec se ce il elle plus
der die das und ist von den dem des zu mit sich auf für nicht ein eine als auch es an im am
el los las y del que en un una por con no para su al lo como más o pero sus
""".split()))
#: Content words in a chain.
CHAIN = 2
#: Content words in a row, without a common word, above which each of them is an anchor itself.
STRETCH = 40
#: The same in a text with fewer than one common word among SPARSE words.
SHORT_STRETCH, SPARSE = 4, 8
#: Likeness below this is reported as 0: with 0 every pair is compared, above it sets of very different lengths need none.
FLOOR = 0.0
#: Rows that are put in order together when texts meet the next document's.
RUN = 1000


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """``df`` with ``out``: the sorted distinct 64-bit signatures of the text column, one for each spot.

    A spot is a content word right behind a common word; its signature is over that anchor and the chain of ``chain`` content
    words that begins with the spot. The start of a text counts as an anchor and its end as a content word, so that every
    text has a signature, null and empty ones the same. In a stretch without common words (over STRETCH content words, or
    over SHORT_STRETCH in a text of few common words) each word is an anchor for the words behind it, up to the end of the
    stretch. Letters are lower-cased; all but letters and digits separates
    words. Work is linear in the text: arrays are shifted and zipped, no lambda looks outside its element, no pattern repeats a group.
    """
    words, spots, runs, sparse = (f"__{out}_{x}" for x in ("words", "spots", "runs", "sparse"))
    split = F.filter(F.split(F.lower(F.coalesce(col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    df = df.withColumn(words, split)
    # each word with the one before it; the end of the text is a null word. Of these, the content words
    zipped = F.arrays_zip(col(words).alias("w"), F.concat(F.array(F.lit("^")), col(words)).alias("p"))
    df = df.withColumn(spots, F.filter(zipped, lambda z: z["w"].isNull() | ~z["w"].isin(ANCHORS)))
    ahead = [F.transform(F.slice(col(spots), k + 1, F.greatest(F.size(spots), F.lit(1))), lambda z: z["w"]).alias(f"h{k}") for k in range(1, chain)]
    chained = F.filter(F.arrays_zip(col(spots).alias("s"), *ahead), lambda z: (z["s"]["p"] == "^") | z["s"]["p"].isin(ANCHORS))
    sigs = F.transform(chained, lambda z: F.xxhash64(z["s"]["p"], z["s"]["w"], *(z[f"h{k}"] for k in range(1, chain))))
    # the stretches between common words; words hold no bar
    marked = F.array_join(F.transform(col(words), lambda w: F.when(w.isin(ANCHORS), F.lit("|")).otherwise(w)), " ")
    df = df.withColumn(runs, F.split(marked, r"\|"))
    df = df.withColumn(sparse, (F.size(runs) - 1) * SPARSE < F.size(words))
    bare = F.filter(F.transform(col(runs), lambda r: F.split(F.trim(r), " ")), lambda ws: F.size(ws) > F.when(col(sparse), SHORT_STRETCH).otherwise(STRETCH))
    chains = lambda ws: F.arrays_zip(ws.alias("h0"), *(F.slice(ws, k + 1, F.size(ws)).alias(f"h{k}") for k in range(1, chain + 1)))
    more = F.transform(F.flatten(F.transform(bare, chains)), lambda z: F.xxhash64(F.lit("~"), *(z[f"h{k}"] for k in range(chain + 1))))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.concat(sigs, more)))).drop(words, spots, runs, sparse)


def fingerprint(sigs: Column) -> Column:
    """The signature set as text: hex numbers in ascending order."""
    return F.lower(F.array_join(F.transform(sigs, F.hex), " "))


def length_part(sigs: Column) -> Column:
    """Partition of a set by its length: the whole part of log2. Sets d partitions apart have a likeness below 2 to the 1 - d."""
    return F.floor(F.log2(F.size(sigs)))


def likeness(a: Column, b: Column, floor: float = FLOOR) -> Column:
    """Jaccard likeness of two signature sets, 0 where it is below ``floor``.

    It is at most the ratio of the lengths: pairs in length partitions too far apart are not intersected at all.
    """
    apart = F.abs(length_part(a) - length_part(b))
    both = F.size(F.array_intersect(a, b))
    near = both / (F.size(a) + F.size(b) - both)
    reach = 64 if floor <= 0 else 1 - math.log2(floor)
    return F.when(apart >= reach, F.lit(0.0)).otherwise(F.when(near >= floor, near).otherwise(F.lit(0.0)))


def dealt_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` with ``run``: numbers that rise with the id, cut at quantiles of the ids, then once more inside each cut.

    Rows that share an id share a run. Runs of null ids come last. Only ids are read for the cuts; texts are not
    stored.
    """
    at = F.coalesce(F.col("id").cast("double"), F.lit(-(2.0**63)))
    coarse = sliced(docs, [], at, run, store=False).withColumnRenamed("_slice", "part").drop("_last", "_off")
    fine = sliced(coarse, ["part"], at, run, store=False)
    number = F.col("part").cast("long") * (2 * RANKS) + F.col("_slice")
    last = F.pmod(F.xxhash64("text"), F.lit(1024)) + 4 * RANKS * RANKS
    return fine.select(*docs.columns, F.when(F.col("id").isNull(), last).otherwise(number).alias("run"))


def with_next(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` (id, text) with ``after``: the text of the next id upwards, of the first after the last; ``own`` and ``theirs``: signatures.

    Rows are dealt to runs of neighbouring ids of about ``run`` rows, however the ids are spread (longer ones in tables of more than
    50,000 runs). Texts move once; only the first row of each run is sent to the run before it. Null ids follow
    all others, dealt by their text. Rows that share an id are ordered by text.
    """
    dealt = dealt_runs(docs, run).repartition("run")
    heads = dealt.groupBy("run").agg(F.min(F.struct("id", "text")).alias("head")).select("run", F.col("head.text").alias("text"))
    follow = _following(dealt.groupBy("run").agg(F.count("*").alias("n")).select("run"))
    tails = follow.join(heads.withColumnRenamed("run", "then"), "then").select("run", F.col("text").alias("tail"))
    tails = with_signatures(tails, "tail", "tail_sigs")
    order = "OVER (PARTITION BY run ORDER BY id, text)"
    rows = with_signatures(dealt, "text", "own")
    rows = rows.withColumns({"lead_text": F.expr(f"lead(text) {order}"), "lead_sigs": F.expr(f"lead(own) {order}")})
    out = rows.join(tails, "run")
    return out.select("id", "text", F.coalesce("lead_text", "tail").alias("after"), "own", F.coalesce("lead_sigs", "tail_sigs").alias("theirs"))


def _following(runs: DataFrame, group: int = 1000) -> DataFrame:
    """(run, then): the next run that has rows, the first after the last. Runs meet by thousands, the groups' first ones in one task."""
    inside = runs.withColumn("g", F.floor(F.col("run") / group)).withColumn("then", F.expr("lead(run) OVER (PARTITION BY g ORDER BY run)"))
    groups = inside.groupBy("g").agg(F.min("run").alias("first"))
    around = groups.select("g", F.expr("coalesce(lead(first) OVER (ORDER BY g), min(first) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))").alias("wrap"))
    return inside.join(around, "g").select("run", F.coalesce("then", "wrap").alias("then"))


def edit_check(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text: the last half of its code points replaced by as many from the start of the next text.

    Null texts count as empty. An empty table gives no rows; a single row is its own next one.
    """
    docs = df.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("n", F.char_length("text").cast("long"))
    half = F.floor(F.col("n") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - half), F.substring("after", F.lit(1), half)))
    rows = with_signatures(rows, "edited", "changed").select("id", "n", "own", "theirs", F.sha2("edited", 256).alias("edited_sha256"), "changed")
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("theirs")).alias("near_next"), length_part(F.col("own")).cast("int").alias("length_part"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return edit_check(table(spark, sf_dir, "documents"))

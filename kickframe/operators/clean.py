"""Cleaning and normalising feed tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions.cols import col, reasons
from kickframe.functions.text import clean_id, fold_name, split_pair


def first_present(df: DataFrame, candidates: Iterable[str], ignore_case: bool = False) -> str | None:
    """The first candidate that is a column of ``df``."""
    have = {c.lower() if ignore_case else c: c for c in df.columns}
    return next((have[c.lower() if ignore_case else c] for c in candidates if (c.lower() if ignore_case else c) in have), None)


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Iterable[str]], keep: Iterable[str] = ()) -> DataFrame:
    """One projection: each target takes the first non-null of its available source columns."""
    lower = {c.lower(): c for c in df.columns}

    def pick(target: str, names: Iterable[str]) -> Column:
        found = [F.col(lower[n.lower()]) for n in names if n.lower() in lower]
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(target)

    return df.select(*keep, *[pick(t, ns) for t, ns in aliases.items()])


def parse_dates(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Dates in mixed formats.

    ISO orders first, then slash dates: an order is certain where one part exceeds 12, and for the rest the
    majority of the certain rows decides (per year width), then dash and dot dates day first.
    """
    s = F.get(F.split(F.trim(F.col(raw)), r"\s+"), 0)
    df = df.withColumn("_raw", s)
    part = lambda i: F.regexp_extract("_raw", r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", i)
    df = df.withColumns(
        {"_a": part(1).try_cast("int"), "_b": part(2).try_cast("int"), "_y": part(3)}
    ).withColumn("_short", F.length("_y") == 2)
    month_first = (F.col("_b") > 12) & (F.col("_a") <= 12)
    day_first = (F.col("_a") > 12) & (F.col("_b") <= 12)

    def vote(short: bool) -> Column:
        rows = df.filter(F.col("_short") == short)
        return rows.agg((F.count_if(day_first) > F.count_if(month_first)).alias("v")).select("v").scalar()

    by_vote = F.when(F.col("_short"), vote(True)).otherwise(vote(False))
    use_day_first = day_first | (~month_first & by_vote)
    year = F.col("_y").try_cast("int")
    year = F.when(F.col("_short"), year + F.when(year >= 69, 1900).otherwise(2000)).otherwise(year)
    day, month = F.when(use_day_first, F.col("_a")).otherwise(F.col("_b")), F.when(use_day_first, F.col("_b")).otherwise(F.col("_a"))
    slash = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    parsed = F.coalesce(
        *[F.try_to_date("_raw", f) for f in ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d")],
        F.when(F.col("_a").isNotNull(), slash),
        *[F.try_to_date("_raw", f) for f in ("d-M-yyyy", "d.M.yyyy")],
    )
    return df.withColumn(out, parsed).drop("_raw", "_a", "_b", "_y", "_short")


def team_lookup(registry: DataFrame) -> dict[str, DataFrame]:
    """Key tables of the four matching tiers from ``registry(code, name)``; ambiguous folds take the least code."""

    def keyed(key: Column) -> DataFrame:
        pairs = registry.select(key.alias("_k"), "code", "name").filter("_k IS NOT NULL AND _k <> ''")
        return pairs.groupBy("_k").agg(F.min_by("name", F.struct("code", "name")).alias("_n"))

    return {
        "code": keyed(F.col("code")),
        "exact": keyed(F.trim("name")),
        "strict": keyed(fold_name("name")),
        "loose": keyed(fold_name("name", loose=True)),
    }


def normalise_team(df: DataFrame, raw: str, registry: DataFrame, out: str = "team") -> DataFrame:
    """Canonical name by code, exact name, folded name, loosely folded name; ``<out>_tier`` tells which hit."""
    keys = {
        "code": clean_id(raw),
        "exact": F.trim(F.col(raw)),
        "strict": fold_name(raw),
        "loose": fold_name(raw, loose=True),
    }
    names, tiers = [], F.when(F.lit(False), "")
    for tier, table in team_lookup(registry).items():
        hit = f"_{tier}"
        df = df.withColumn("_k", keys[tier]).join(table.withColumnRenamed("_n", hit), "_k", "left").drop("_k")
        names.append(F.col(hit))
        tiers = tiers.when(F.col(hit).isNotNull(), tier)
    return df.withColumns({out: F.coalesce(*names), f"{out}_tier": F.coalesce(tiers, F.lit("none"))}).drop(
        *[f"_{t}" for t in keys]
    )


def stat_pairs(
    df: DataFrame, pairs: Mapping[str, Mapping[str, object]], overwrite: bool = False
) -> DataFrame:
    """Canonical home/away statistics: an own column, else split columns, else a packed ``H-A`` text.

    ``pairs[stat] = {"split": (h, a), "packed": c}``; ``overwrite`` lets the raw sources win.
    """
    out = {}
    for stat, src in pairs.items():
        packed = split_pair(src["packed"]) if src.get("packed") in df.columns else (F.lit(None), F.lit(None))
        for at, side in enumerate(("h", "a")):
            target = f"{stat}_{side}"
            raw = []
            if src.get("split") and src["split"][at] in df.columns:
                raw.append(F.col(src["split"][at]).try_cast("double"))
            raw.append(packed[at].cast("double"))
            own = [F.col(target).try_cast("double")] if target in df.columns else []
            out[target] = F.coalesce(*(raw + own if overwrite else own + raw))
    return df.withColumns(out)


def scope_chain(df: DataFrame, steps: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every step, and the count left after each step, the counts in a single pass."""
    passed, counts, conds = F.lit(True), [F.count(F.lit(1)).alias("rows_in")], []
    for name, cond in steps.items():
        passed = passed & F.coalesce(cond, F.lit(False))
        conds.append(F.coalesce(cond, F.lit(False)))
        counts.append(F.count_if(passed).alias(f"after_{name}"))
    return df.filter(passed), df.agg(*counts)


def next_round(df: DataFrame, days: int = 3, by: Iterable[str] = ()) -> DataFrame:
    """Fixtures within ``days`` of the earliest one, over all rows or per group."""
    span = F.expr(f"INTERVAL {int(days)} DAYS")
    by = list(by)
    if by:
        firsts = df.groupBy(*by).agg((F.min("kickoff") + span).alias("_until"))
        return df.join(firsts, by).filter("kickoff <= _until").drop("_until")
    until = df.agg((F.min("kickoff") + span).alias("u")).select("u").scalar()
    return df.filter(F.col("kickoff") <= until)


def quality_status(df: DataFrame, flags: list[tuple[Column, str]], critical: Iterable[str]) -> DataFrame:
    """Ordered flag list, a critical bit and OK / WARN / BAD."""
    df = df.withColumn("_flags", reasons(*flags))
    bad = F.arrays_overlap("_flags", F.array(*[F.lit(c) for c in critical]))
    return df.withColumns(
        {
            "quality_flags": F.array_join("_flags", "|"),
            "quality_critical": bad.cast("int"),
            "quality_status": F.when(bad, "BAD").when(F.size("_flags") > 0, "WARN").otherwise("OK"),
        }
    ).drop("_flags")


def require_columns(df: DataFrame, required: Iterable[str], context: str) -> DataFrame:
    """Contract check at plan build."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{context}: missing columns {missing}")
    return df


def constant_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row per column that must be constant: distinct non-null values, bounded by two, and whether it holds."""
    aggs = []
    for c in columns:
        lo, hi = F.min(c), F.max(c)
        aggs.append(F.struct(F.lit(c).alias("column"), lo.cast("string").alias("value"), lo.eqNullSafe(hi).alias("constant")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def feature_columns(df: DataFrame, ban_exact: Iterable[str], ban_tokens: Iterable[str]) -> list[str]:
    """Numeric columns not banned by name or by a token in the name."""
    exact, tokens = {b.lower() for b in ban_exact}, [b.lower() for b in ban_tokens]
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [
        c for c, t in df.dtypes if t in numeric and c.lower() not in exact and not any(b in c.lower() for b in tokens)
    ]


def drop_sparse(df: DataFrame, threshold: int = 10) -> DataFrame:
    """Drop columns with more nulls than the threshold (one pass over the data), then rows with any null."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    kept = [c for c in df.columns if counts[c] <= threshold]
    return df.select(*kept).dropna()


def rename_by(df: DataFrame, target: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """Conditional rename of a label, e.g. a league name that depends on the country."""
    out = F.when(F.lit(False), "")
    for cond, label in rules:
        out = out.when(cond, label)
    return df.withColumn(target, F.coalesce(out, col(target)))

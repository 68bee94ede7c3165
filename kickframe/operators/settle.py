"""Outcome labels, buckets and bet settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions.cols import unix
from kickframe.operators.ordered import running
from kickframe.session import stored

# Bucket bounds and labels.
ODDS_STEPS = [(1.70, "<1.70"), (2.10, "1.70-2.09"), (2.60, "2.10-2.59")]
PROB_STEPS = [(0.52, "<0.52"), (0.56, "0.52-0.55"), (0.60, "0.56-0.59"), (0.65, "0.60-0.64")]


def won(market: Column, home: Column, away: Column) -> Column:
    """Whether a totals or both-score pick won; null without a result."""
    total, both = home + away, (home > 0) & (away > 0)
    return (
        F.when(home.isNull() | away.isNull(), None)
        .when(market == "OU25_OVER", total > 2.5)
        .when(market == "OU25_UNDER", total < 2.5)
        .when(market == "BTTS_YES", both)
        .when(market == "BTTS_NO", ~both)
    )


def settle_bets(bets: DataFrame) -> DataFrame:
    """Result of 1X2, double chance, totals (with push), interval and exact-total bets, payout and net.

    Needs ``market, selection, odds, stake, ft_home, ft_away``.
    """
    h, a = F.col("ft_home"), F.col("ft_away")
    total = (h + a).cast("double")
    sel, market = F.upper(F.trim("selection")), F.trim("market")
    digit = F.when(h > a, "1").when(h < a, "2").otherwise("X")
    side = F.translate(sel, "HDA", "1X2")
    line = F.regexp_extract(market, r"^OU\s+([0-9.]+)$", 1).try_cast("double")
    lo = F.regexp_extract(sel, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    hi = F.regexp_extract(sel, r"-\s*(\d+(?:\.\d+)?)$", 1).try_cast("double")
    win = lambda c: F.when(c, "WIN").otherwise("LOSS")
    over_under = (
        F.when(line.isNull(), "UNKNOWN")
        .when(total == line, "PUSH")
        .otherwise(win(F.when(total > line, sel.startswith("O")).otherwise(sel.startswith("U"))))
    )
    interval = (
        F.when(lo.isNull(), "UNKNOWN")
        .when(sel.contains("+"), win(total >= lo))
        .when(sel.contains("-"), F.when(hi.isNull(), "UNKNOWN").otherwise(win((total >= lo) & (total <= hi))))
        .otherwise(win(total == lo))
    )
    result = (
        F.when(h.isNull() | a.isNull(), "PENDING")
        .when(market == "1X2", win(side == digit))
        .when(market == "DC", win(sel.contains(digit)))
        .when(market.startswith("OU "), over_under)
        .when(market == "TG Interval", interval)
        .otherwise("PENDING")
    )
    df = bets.withColumn("result", result)
    payout = F.when(F.col("result") == "WIN", F.col("stake") * F.col("odds")).when(F.col("result") == "PUSH", F.col("stake")).otherwise(0.0)
    closed = F.col("result").isin("WIN", "LOSS", "PUSH")
    df = df.withColumn("payout", F.when(closed, F.round(payout, 2)).otherwise(0.0))
    return df.withColumn("net", F.when(closed, F.round(F.col("payout") - F.col("stake"), 2)).otherwise(0.0))


def running_balance(bets: DataFrame, start: float, keys: list[str], order: list[str], ts: str) -> DataFrame:
    """Balance after each bet in order."""
    out = running(bets, keys, order, {"_sum": F.col("net")}, unix(ts), inclusive=True)
    return out.withColumn("balance", F.lit(start) + F.col("_sum")).drop("_sum")


def longest_losing_run(df: DataFrame, keys: list[str], order: list[str], at: Column) -> DataFrame:
    """Longest run of misses per key: misses share the count of hits before them, islands are counted map-side."""
    marked = running(df, keys, order, {"_wins": F.col("hit").cast("int")}, at)
    islands = marked.groupBy(*keys, "_wins").agg(F.count_if(~F.col("hit")).alias("_run"))
    return islands.groupBy(*keys).agg(F.max("_run").alias("max_loss_run"))


def max_drawdown(df: DataFrame, keys: list[str], order: list[str], at: str, step: Column) -> DataFrame:
    """Deepest fall of the running sum below its peak, the peak starting at zero."""
    cut = F.col(at)
    first = running(df.withColumn("_step", step), keys, order, {"_eq": F.col("_step")}, cut, inclusive=True)
    first = stored(first)
    second = running(first, keys, order, {}, cut, maxes={"_peak": F.col("_eq")}, inclusive=True)
    fall = F.col("_eq") - F.greatest(F.lit(0), F.col("_peak"))
    return second.groupBy(*keys).agg(F.least(F.lit(0.0), F.min(fall)).alias("max_drawdown"))

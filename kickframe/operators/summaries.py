"""Grouped summaries over matches, teams, leagues and backtests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions.cols import clamp, flag, ratio
from kickframe.functions.text import minutes_list

MEANS = {
    "lg_gf_home": "ft_home", "lg_gf_away": "ft_away", "lg_shots_home": "shots_h", "lg_shots_away": "shots_a",
    "lg_sot_home": "sot_h", "lg_sot_away": "sot_a", "lg_cor_home": "corners_h", "lg_cor_away": "corners_a",
    "lg_pos_home": "pos_h", "lg_pos_away": "pos_a",
}


def league_baselines(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of every statistic per key; null keys form their own group."""
    return df.groupBy(*keys).agg(*[F.avg(src).alias(name) for name, src in MEANS.items()])


def with_baselines(df: DataFrame) -> DataFrame:
    """League-season means by (country, league, season), else by (league, season)."""
    primary = league_baselines(df, ["country", "league", "season"])
    fallback = league_baselines(df, ["league", "season"])
    names = list(MEANS)
    joined = df.join(primary, ["country", "league", "season"], "left").join(
        fallback.select("league", "season", *[F.col(n).alias(f"_fb_{n}") for n in names]), ["league", "season"], "left"
    )
    return joined.select(*df.columns, *[F.coalesce(n, f"_fb_{n}").alias(n) for n in names])


def team_seasons(df: DataFrame) -> DataFrame:
    """Goals for and against at home and away with match counts per team and season; one aggregation over side rows."""
    from kickframe.operators.sides import side_rows

    s = side_rows(df, {"gf": ("ft_home", "ft_away"), "ga": ("ft_away", "ft_home")}, keep=("season",))
    at = lambda venue, c: F.sum(F.when(F.col("venue") == venue, F.col(c)))
    return s.groupBy("team", "season").agg(
        at("home", "gf").alias("gf_home"),
        at("home", "ga").alias("ga_home"),
        at("away", "gf").alias("gf_away"),
        at("away", "ga").alias("ga_away"),
        F.count_if(F.col("venue") == "home").alias("matches_home"),
        F.count_if(F.col("venue") == "away").alias("matches_away"),
    )


def most_common(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[Column] = ()) -> DataFrame:
    """Most frequent value per key; ties by the given expressions, then the smallest value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.struct((-F.col("_n")).alias("n"), *[t.alias(f"t{i}") for i, t in enumerate(ties)], F.col(value))
    return counted.groupBy(*keys).agg(F.min_by(value, rank).alias(value))


def home_bonus(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean home goal margin as rating points: signed 400*log10(1+|margin|), clipped."""
    margin = clamp(F.col("_m"), -5.0, 5.0)
    bonus = clamp(F.lit(400.0) * F.signum(margin) * F.log10(1.0 + F.abs(margin)), -200.0, 200.0)
    return (
        df.groupBy(*keys)
        .agg(F.avg(F.col("ft_home") - F.col("ft_away")).alias("_m"))
        .select(*keys, F.coalesce(bonus, F.lit(0.0)).alias("home_bonus"))
    )


def coverage(df: DataFrame, groups: dict[str, Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """Per group of columns: rows with all of them, and the least column-wise ratio."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for name, cols in groups.items():
        full = F.lit(True)
        for c in cols:
            full = full & F.col(c).isNotNull()
        aggs.append(F.count_if(full).alias(f"{name}_rows"))
        least = [F.count(c) / F.count(F.lit(1)) for c in cols]
        aggs.append((F.least(*least) if len(least) > 1 else least[0]).alias(f"{name}_ratio"))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def timing_profiles(goals: DataFrame) -> DataFrame:
    """Goals per team in six time bins, scored and conceded, with the overall share as prior.

    ``goals`` has ``home, away, goalsh, goalsa`` (minute lists).
    """
    b = lambda m: F.least(F.greatest(F.floor((m - 1) / 15), F.lit(0)), F.lit(5)).cast("int")
    scored_h, scored_a = minutes_list("goalsh"), minutes_list("goalsa")

    def rows(team: str, own: Column, other: Column) -> Column:
        played = F.array(F.struct(F.col(team).alias("team"), F.lit("match").alias("kind"), F.lit(-1).alias("bin")))
        tag = lambda kind: lambda m: F.struct(F.col(team).alias("team"), F.lit(kind).alias("kind"), b(m).alias("bin"))
        return F.concat(played, F.transform(own, tag("scored")), F.transform(other, tag("conceded")))

    long = goals.select(F.inline(F.concat(rows("home", scored_h, scored_a), rows("away", scored_a, scored_h))))
    counts = [
        F.count_if((F.col("kind") == k) & (F.col("bin") == i)).alias(f"{k}_{i}") for k in ("scored", "conceded") for i in range(6)
    ]
    return long.groupBy("team").agg(
        F.count_if(F.col("kind") == "match").alias("matches"),
        F.count_if(F.col("kind") == "scored").alias("scored"),
        F.count_if(F.col("kind") == "conceded").alias("conceded"),
        *counts,
    )


def group_hits(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Picks, wins, losses, hit rate, mean probability and the share of first-tier gates per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("picks"),
        F.count_if("hit").alias("wins"),
        F.count_if(~F.col("hit")).alias("losses"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        F.avg("p_model").alias("avg_p"),
        F.avg((F.col("gate_tier") == "primary").cast("double")).alias("primary_share"),
    )


def confusion(df: DataFrame, by: Sequence[str], truth: Column, pred: Column) -> DataFrame:
    """Confusion counts, accuracy, balanced accuracy and yes-rate."""
    counted = df.groupBy(*by).agg(
        F.count_if(truth & pred).alias("tp"),
        F.count_if(~truth & ~pred).alias("tn"),
        F.count_if(~truth & pred).alias("fp"),
        F.count_if(truth & ~pred).alias("fn"),
    )
    return with_rates(counted)


def with_rates(df: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    tpr, tnr = F.coalesce(ratio(tp, tp + fn), F.lit(0.0)), F.coalesce(ratio(tn, tn + fp), F.lit(0.0))
    return df.withColumns(
        {
            "accuracy": F.coalesce(ratio(tp + tn, n), F.lit(0.0)),
            "balanced_accuracy": 0.5 * (tpr + tnr),
            "yes_rate": F.coalesce(ratio(tp + fp, n), F.lit(0.0)),
        }
    )


def threshold_counts(df: DataFrame, by: Sequence[str], prob: str, truth: Column, t_min: float, t_max: float, step: float) -> DataFrame:
    """Confusion counts at every threshold of a grid.

    Rows are counted once per grid cell and the cells are summed from above, instead of repeating every
    row for every threshold. ``pred`` is ``prob >= t``.
    """
    n = int(round((t_max - t_min) / step)) + 1
    at = lambda k: F.round(F.lit(t_min) + k * F.lit(step), 6)
    k0 = F.floor((F.col(prob) - t_min) / step)
    k = F.when(F.col(prob) < at(k0), k0 - 1).when(F.col(prob) >= at(k0 + 1), k0 + 1).otherwise(k0)
    cell = F.least(F.greatest(k, F.lit(-1)), F.lit(n - 1))
    cells = (
        df.filter(F.col(prob).isNotNull())
        .groupBy(*by, cell.alias("_k"))
        .agg(F.count_if(truth).alias("_p"), F.count_if(~truth).alias("_q"))
    )
    # at most n + 1 cells per group: spread each over the thresholds it passes
    spread = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    passed = F.col("_k") >= F.col("i")
    grid = spread.groupBy(*by, "i").agg(
        F.sum(F.when(passed, F.col("_p")).otherwise(0)).alias("tp"),
        F.sum(F.when(~passed, F.col("_q")).otherwise(0)).alias("tn"),
        F.sum(F.when(passed, F.col("_q")).otherwise(0)).alias("fp"),
        F.sum(F.when(~passed, F.col("_p")).otherwise(0)).alias("fn"),
    )
    return with_rates(grid.withColumn("threshold", at(F.col("i"))).drop("i"))


def best_threshold(grid: DataFrame, by: Sequence[str], metric: str = "balanced_accuracy", min_yes: float = 0.0, max_yes: float = 1.0) -> DataFrame:
    """Threshold with the best metric inside the yes-rate guard, the lowest one on ties."""
    ok = grid.filter(F.col("yes_rate").between(min_yes, max_yes))
    rank = F.struct(F.round(metric, 12), -F.col("threshold"))
    best = ok.groupBy(*by).agg(F.max_by(F.struct("threshold", metric, "yes_rate"), rank).alias("_b"))
    return best.select(*by, "_b.*")


def calibration_error(df: DataFrame, by: Sequence[str], prob: str, truth: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = F.least(F.greatest(F.floor(F.col(prob) * bins), F.lit(0)), F.lit(bins - 1))
    cells = df.groupBy(*by, b.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(prob).alias("_conf"), F.avg(truth.cast("double")).alias("_acc")
    )
    total = F.sum("_n")
    return cells.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_acc") - F.col("_conf"))) / total).alias("ece"), total.alias("n"))


def crps_poisson(mu: Column, actual: Column, goals: int = 24) -> Column:
    """Continuous ranked probability score of a Poisson total cut at ``goals``."""
    zero = F.struct(F.exp(-mu).alias("pmf"), F.lit(0.0).alias("cdf"), F.lit(0.0).alias("score"))

    def step(acc: Column, k: Column) -> Column:
        pmf = F.when(k == 0, acc["pmf"]).otherwise(acc["pmf"] * mu / k)
        cdf = acc["cdf"] + pmf
        miss = cdf - (k >= actual).cast("double")
        return F.struct(pmf.alias("pmf"), cdf.alias("cdf"), (acc["score"] + miss * miss).alias("score"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(goals)), zero, step)["score"]


def side_errors(df: DataFrame, by: Sequence[str], mu: tuple[str, str], goals: tuple[str, str]) -> DataFrame:
    """Side and total RMSE, Poisson deviance part, Brier and log loss of scoring at all; one pass over matches."""
    s = df.select(
        *by,
        F.inline(
            F.array(
                *[F.struct(F.greatest(F.col(m), F.lit(1e-6)).alias("mu"), F.col(g).cast("double").alias("y"), (F.col(mu[0]) + F.col(mu[1])).alias("mt"), (F.col(goals[0]) + F.col(goals[1])).alias("yt")) for m, g in zip(mu, goals)]
            )
        ),
    ).filter("mu IS NOT NULL AND y IS NOT NULL")
    p = clamp(1 - F.exp(-F.col("mu")), 1e-6, 1 - 1e-6)
    o = (F.col("y") > 0).cast("double")
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    aggs = [
        F.count(F.lit(1)).alias("n_sides"),
        F.sqrt(F.avg(sq("mu", "y"))).alias("side_rmse"),
        F.sqrt(F.avg(sq("mt", "yt"))).alias("total_rmse"),
        F.avg(F.col("mu") - F.col("y") * F.ln("mu")).alias("poisson_nll"),
        F.avg((p - o) * (p - o)).alias("brier"),
        F.avg(-(o * F.ln(p) + (1 - o) * F.ln(1 - p))).alias("logloss"),
    ]
    return s.groupBy(*by).agg(*aggs) if by else s.agg(*aggs)


def unpivot_bets(df: DataFrame, markets: dict[str, tuple[str, str, Column]], keep: Iterable[str]) -> DataFrame:
    """Long rows ``market, p, odds, hit, ev`` from wide columns; markets[name] = (prob, odds, won)."""
    rows = [
        F.struct(F.lit(m).alias("market"), F.col(p).alias("p"), F.col(o).alias("odds"), won.alias("hit"), (F.col(p) * F.col(o) - 1).alias("ev"))
        for m, (p, o, won) in markets.items()
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def roi(bets: DataFrame, by: Sequence[str], min_ev: float = 0.0) -> DataFrame:
    """Flat-stake result of all bets above an EV."""
    profit = F.when(F.col("hit"), F.col("odds") - 1).otherwise(F.lit(-1.0))
    return bets.filter(F.col("ev") > min_ev).groupBy(*by).agg(
        F.count(F.lit(1)).alias("bets"),
        F.count_if("hit").alias("wins"),
        (100 * F.avg(profit)).alias("roi_pct"),
        (100 * F.avg(flag(F.col("hit")).cast("double"))).alias("win_rate_pct"),
    )


def shot_summary(shots: DataFrame, xg: str = "p_goal") -> DataFrame:
    """Shots per match and side: shots, goals, xG, the part after corners, and both efficiencies."""
    goal, corner = F.col("result") == "Goal", F.lower("situation").contains("corner")

    def part(side: str) -> list[Column]:
        mine = F.col("h_a") == side
        return [
            F.count_if(mine).alias(f"shots_{side}"),
            F.count_if(mine & goal).alias(f"goals_{side}"),
            F.coalesce(F.sum(F.when(mine, F.col(xg))), F.lit(0.0)).alias(f"xg_{side}"),
            F.count_if(mine & corner).alias(f"corner_shots_{side}"),
            F.count_if(mine & corner & goal).alias(f"corner_goals_{side}"),
            F.coalesce(F.sum(F.when(mine & corner, F.col(xg))), F.lit(0.0)).alias(f"corner_xg_{side}"),
        ]

    wide = shots.groupBy("fixture_id").agg(*part("h"), *part("a"))
    names = ["shots", "goals", "xg", "corner_shots", "corner_goals", "corner_xg"]
    side = lambda s, o: F.struct(
        F.lit(s).alias("side"),
        *[F.col(f"{n}_{s}").alias(f"{n}_for") for n in names],
        *[F.col(f"{n}_{o}").alias(f"{n}_against") for n in names],
    )
    long = wide.select("fixture_id", F.inline(F.array(side("h", "a"), side("a", "h"))))
    return long.withColumns(
        {
            "finishing": F.col("goals_for") - F.col("xg_for"),
            "goalkeeping": F.col("xg_against") - F.col("goals_against"),
        }
    )

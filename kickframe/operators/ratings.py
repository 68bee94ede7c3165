"""Ratings: an Elo series with per-row trace, by pool.

An update needs both current ratings, so a pool is a recursion in time. ``elo_series`` solves it parallel in time: chunks of a pool
walk at once from guessed openings, and their closings correct the openings of later chunks until nothing moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kickframe import config
from kickframe.functions.cols import band, unix
from kickframe.operators.ordered import running, sliced
from kickframe.session import cut_lineage


@dataclass(frozen=True)
class EloRules:
    start: float = 1500.0
    k: float = 20.0
    home_edge: float = 65.0
    margin_cap: float = 2.75
    upset_low: float = 0.35
    upset_high: float = 0.65
    upset_mult: float = 1.20
    new_games: int = 12
    new_mult: float = 1.25
    floor: float = 1000.0
    by_league: dict = field(default_factory=lambda: config.ELO_LEAGUE)
    by_type: dict = field(default_factory=lambda: config.ELO_MATCH_TYPE)


def _static(df: DataFrame, rules: EloRules) -> DataFrame:
    """Row-wise inputs of an update: step, home edge, margin factor, outcome."""
    def league(i: int, default: float) -> Column:
        out = F.when(F.lit(False), F.lit(default))
        for name, v in rules.by_league.items():
            out = out.when(F.lower(F.trim("league")) == name.lower(), F.lit(v[i]))
        return out.otherwise(F.lit(default))

    kind = F.col("match_type") if "match_type" in df.columns else F.lit("league")
    mult = F.when(F.lit(False), F.lit(1.0))
    for name, v in rules.by_type.items():
        mult = mult.when(kind == name, F.lit(v))
    h, a = F.col("ft_home").cast("double"), F.col("ft_away").cast("double")
    gap = F.abs(h - a)
    margin = F.when(gap <= 1, 1.0).when(gap == 2, 1.5).otherwise((11.0 + gap) / 8.0)
    return df.withColumns(
        {
            "k_base": league(0, rules.k),
            "home_edge": league(1, rules.home_edge),
            "type_mult": mult.otherwise(F.lit(1.0)),
            "margin_mult": F.least(margin, F.lit(rules.margin_cap)),
            "actual": F.when(h > a, 1.0).when(h == a, 0.5).when(h < a, 0.0),
        }
    )


TRACE = ["elo_home", "elo_away", "expected", "new_mult", "upset_mult", "k_used", "delta"]


def apply_match(m, state: dict, rules: EloRules) -> tuple:
    """Trace of one match, state (team -> [rating, games]) moved on; shared by the batch and the streaming series."""
    h, a = (state.setdefault(t, [rules.start, 0]) for t in (m.home, m.away))
    rh, ra = h[0], a[0]
    fresh = rules.new_mult if min(h[1], a[1]) < rules.new_games else 1.0
    if m.actual is None or m.actual != m.actual:
        return rh, ra, None, fresh, 1.0, None, None
    exp = 1.0 / (1.0 + 10.0 ** (-(rh + m.home_edge - ra) / 400.0))
    shock = (m.actual == 1.0 and exp < rules.upset_low) or (m.actual == 0.0 and exp > rules.upset_high)
    upset = rules.upset_mult if shock else 1.0
    used = m.k_base * m.type_mult * fresh * upset
    delta = used * m.margin_mult * (m.actual - exp)
    h[0], a[0] = max(rules.floor, rh + delta), max(rules.floor, ra - delta)
    h[1], a[1] = h[1] + 1, a[1] + 1
    return rh, ra, exp, fresh, upset, used, delta


#: Matches of a pool that one task walks through in a row.
CHUNK = 20_000
#: Opening ratings of a chunk that move by less than this leave it settled.
SETTLED = 1e-9

_MATCH = ["_t", "home", "away", "fixture_id", "k_base", "home_edge", "type_mult", "margin_mult", "actual"]
_STEP = "pool_ string, chunk_ int, kind_ int, t_ long, home string, away string, fixture_id long, k_base double, home_edge double, type_mult double, margin_mult double, actual double, rating double, games long"


def _walk(rows: DataFrame, rules: EloRules, trace: bool) -> DataFrame:
    """Every chunk from its opening ratings: traces of its matches, or its closing ratings.

    A chunk's openings (kind 0) come before its matches; it streams through its task with a rating and a count per team.
    """
    from types import SimpleNamespace

    names = [f.split()[0] for f in _STEP.split(", ")]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, {}

        def closings() -> list[tuple]:
            return [(*at, team, r[0]) for team, r in state.items()] if at else []

        for pdf in frames:
            out = []
            for m in zip(*(pdf[c].tolist() for c in names), strict=True):
                row = SimpleNamespace(**dict(zip(names, m, strict=True)))
                if (row.pool_, row.chunk_) != at:
                    if not trace:
                        out += closings()
                    at, state = (row.pool_, row.chunk_), {}
                if row.kind_ == 0:
                    state[row.home] = [row.rating, row.games]
                    continue
                moved = apply_match(row, state, rules)
                if trace:
                    out.append((row.fixture_id, *moved))
            if out:
                yield pd.DataFrame(out, columns=["fixture_id", *TRACE] if trace else ["pool_", "chunk_", "team", "closing"])
        if at and not trace:
            yield pd.DataFrame(closings(), columns=["pool_", "chunk_", "team", "closing"])

    dealt = rows.repartition("pool_", "chunk_").sortWithinPartitions("pool_", "chunk_", "kind_", "t_", "home", "away", "fixture_id")
    schema = "fixture_id long, " + ", ".join(f"{c} double" for c in TRACE) if trace else "pool_ string, chunk_ int, team string, closing double"
    return dealt.mapInPandas(walk, schema)


def elo_series(df: DataFrame, pool: str = "league", rules: EloRules | None = None, chunk_rows: int = CHUNK) -> DataFrame:
    """Pre-match ratings and the trace of every update, one row per match.

    A pool is cut in time into chunks of about ``chunk_rows`` matches, which all walk at once. A chunk opens with exact counts of
    games and, at first, the start rating of every team; closing ratings become the openings of later chunks, and chunks whose
    openings moved walk again, until none moves by more than 1e-9. Old ratings fade and every walk adds nothing to a pool's
    total, so few sweeps are needed; by causality a pool of c chunks is settled after c sweeps, and more is an error. Pools of one
    chunk walk once. Rows without a pool form one; rows without a score keep their ratings and change none.
    """
    rules = rules or EloRules()
    base = _static(df, rules).withColumns({"_t": unix("kickoff"), "_pool": F.col(pool).cast("string")}).select("_pool", *_MATCH)
    cut = cut_lineage(sliced(base, ["_pool"], F.col("_t"), chunk_rows).withColumnRenamed("_slice", "_chunk"))
    played = F.col("actual").isNotNull().cast("long")
    teams = cut.select("_pool", "_chunk", F.inline(F.array(*[F.struct(F.col(v).alias("team"), played.alias("n")) for v in ("home", "away")])))
    # one row per team and chunk it plays in; games before the chunk are exact from the start
    past = W.partitionBy("_pool", "team").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    opening = teams.groupBy("_pool", "_chunk", "team").agg(F.sum("n").alias("n"))
    opening = cut_lineage(opening.select("_pool", "_chunk", "team", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("games"), F.lit(rules.start).alias("rating")))
    matches = cut.select(F.col("_pool").alias("pool_"), F.col("_chunk").cast("int").alias("chunk_"), F.lit(1).alias("kind_"), F.col("_t").alias("t_"), "home", "away", F.col("fixture_id").cast("long").alias("fixture_id"), *[F.col(c).cast("double").alias(c) for c in _MATCH[4:]], F.lit(None).cast("double").alias("rating"), F.lit(None).cast("long").alias("games"))

    def rows(of: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
        states = of.select(F.col("_pool").alias("pool_"), F.col("_chunk").cast("int").alias("chunk_"), F.lit(0).alias("kind_"), F.lit(None).cast("long").alias("t_"), F.col("team").alias("home"), F.lit("").alias("away"), F.lit(None).cast("long").alias("fixture_id"), *[F.lit(None).cast("double").alias(c) for c in _MATCH[4:]], "rating", "games")
        both = states.unionByName(matches)
        if chunks is None:
            return both
        wanted = chunks.select(F.col("_pool").alias("_wp"), F.col("_chunk").cast("int").alias("_wc"))
        return both.join(wanted, F.col("pool_").eqNullSafe(F.col("_wp")) & (F.col("chunk_") == F.col("_wc")), "left_semi")

    sweeps = cut.agg(F.max("_last")).first()[0] or 0
    if sweeps:
        several = cut.where("_last > 0").select("_pool", "_chunk").distinct()
        closings: DataFrame | None = None
        moving: DataFrame | None = several
        for _ in range(sweeps + 1):
            walked = _walk(rows(opening, moving), rules, False).select(F.col("pool_").alias("_pool"), F.col("chunk_").alias("_chunk"), "team", "closing")
            same = lambda a, b: F.col(f"{a}._pool").eqNullSafe(F.col(f"{b}._pool")) & (F.col(f"{a}._chunk") == F.col(f"{b}._chunk"))
            if closings is not None:
                walked = walked.unionByName(closings.alias("c").join(moving.alias("m"), same("c", "m"), "left_anti"))
            closings = cut_lineage(walked)
            told = opening.alias("o").join(closings.alias("c"), same("o", "c") & (F.col("o.team") == F.col("c.team")), "left").select("o.*", "c.closing")
            after = told.withColumn("_new", F.coalesce(F.last("closing", ignorenulls=True).over(past), F.lit(rules.start)))
            after = cut_lineage(after.withColumn("_gap", F.abs(F.col("_new") - F.col("rating"))).drop("closing"))
            opening = after.select("_pool", "_chunk", "team", "games", F.col("_new").alias("rating"))
            moving = after.where(F.col("_gap") > SETTLED).select("_pool", "_chunk").distinct()
            if moving.isEmpty():
                break
        else:
            raise RuntimeError("ratings did not settle")
    out = _walk(rows(opening), rules, True)
    return out.select("fixture_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in TRACE])


def final_ratings(matches: DataFrame, series: DataFrame, rules: EloRules | None = None) -> DataFrame:
    """Rating of every team after its last match, floor applied."""
    rules = rules or EloRules()
    df = matches.select("fixture_id", "kickoff", "home", "away").join(series, "fixture_id")
    d = F.coalesce("delta", F.lit(0.0))
    row = lambda team, own, sign: F.struct(F.col(team).alias("team"), F.greatest(F.lit(rules.floor), F.col(own) + sign * d).alias("rating"))
    rows = df.select("kickoff", F.struct("home", "away", "fixture_id").alias("_tie"), F.inline(F.array(row("home", "elo_home", F.lit(1.0)), row("away", "elo_away", F.lit(-1.0)))))
    return rows.groupBy("team").agg(F.max_by("rating", F.struct("kickoff", "_tie")).alias("rating"))


def attach_ratings(matches: DataFrame, series: DataFrame, home_edge: float = 65.0, width: float = 150.0) -> DataFrame:
    """Ratings, their difference with home edge, and both strength bands on the match rows."""
    df = matches.join(series.select("fixture_id", "elo_home", "elo_away"), "fixture_id")
    diff = F.col("elo_home") + home_edge - F.col("elo_away")
    return df.withColumns({"elo_diff": diff, "band_home": band(diff, width), "band_away": band(-diff, width)})


# ---------------------------------------------------------------- league state of latest team values


def state_z(
    matches: DataFrame, group: list[str], states: dict[str, list[tuple[str, str]]], asks: dict[str, tuple[str, str]], order: list[str]
) -> DataFrame:
    """z-scores of a value against the latest value of every team of the group before the match.

    ``states[name]`` lists (team column, new value column) pairs a match updates; ``asks[out] = (state, value)``.
    A state's mean and spread follow from running sums of changes: each update adds ``v - previous`` and
    ``v^2 - previous^2``, the first one of a team counts it.
    """
    from kickframe.functions.cols import zscore
    from kickframe.operators.ordered import last_before

    # the table is read by several branches below: write it once instead of recomputing its windows
    matches = cut_lineage(matches)
    cut = unix("kickoff")
    v, p, st = F.col("_v"), F.col("_p"), F.col("_st")
    rows = [
        F.struct(F.lit(n).alias("_st"), F.col(team).alias("_team"), F.col(c).cast("double").alias("_v"))
        for n, updates in states.items()
        for team, c in updates
    ]
    # the updates of all states run through one pass, keyed by state
    long = matches.select(*dict.fromkeys([*group, *order]), F.inline(F.array(*rows)))
    prev = last_before(long, ["_st", *group, "_team"], order, {"_p": v}, cut, F.struct(*order)).filter(v.isNotNull())
    was = F.coalesce(p, F.lit(0.0))
    aggs = []
    for n in states:
        mine = st == n
        aggs += [
            F.sum(F.when(mine, v - was)).alias(f"_d1_{n}"),
            F.sum(F.when(mine, v * v - was * was)).alias(f"_d2_{n}"),
            F.sum(F.when(mine, p.isNull().cast("int"))).alias(f"_d0_{n}"),
        ]
    df = matches.join(prev.groupBy("fixture_id").agg(*aggs), "fixture_id", "left")
    sums = {f"_s{i}_{n}": F.coalesce(f"_d{i}_{n}", F.lit(0)) for n in states for i in (0, 1, 2)}
    df = running(df, group, order, sums, cut)
    for name in states:
        n = F.col(f"_s0_{name}")
        mean = F.try_divide(F.col(f"_s1_{name}"), n)
        df = df.withColumn(f"_mean_{name}", mean)
        var = F.try_divide(F.col(f"_s2_{name}"), n) - F.col(f"_mean_{name}") * F.col(f"_mean_{name}")
        df = df.withColumn(f"_sd_{name}", F.when(var > 1e-9, F.sqrt(var)).otherwise(F.lit(0.0)))
    out = {o: zscore(F.col(v).cast("double"), F.col(f"_mean_{s}"), F.col(f"_sd_{s}")) for o, (s, v) in asks.items()}
    return df.withColumns(out).select(*matches.columns, *out)

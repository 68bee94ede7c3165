"""Team form: rolling, decayed, pressure and expected-goal form, strengths and streaks, all leakage-safe."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickframe.functions.cols import clamp, col, ratio, unix, weighted_present
from kickframe.operators.ordered import ewma, first_of_ties, haloed, last_before, rows_frame, running
from kickframe.operators.scan import affine_scan

TEAM_VENUE = ("team", "venue")
ORDER = ("kickoff", "opp", "fixture_id")

# Share of each dominance component in the pressure index.
PRESSURE_WEIGHTS = {
    "shots": 0.45,
    "sot": 0.30,
    "corners": 0.15,
    "pos": 0.10,
    "goal_attempts": 0.12,
    "shots_off": 0.06,
    "blocked_shots": 0.05,
    "attacks": 0.05,
    "dangerous_attacks": 0.10,
}
NEUTRAL = 0.5
DECAY_RATE = 0.693


def mean_over(c: Column | str):
    return lambda w, _: F.avg(col(c)).over(w)


def rolling_form(
    sides: DataFrame,
    stats: Iterable[str],
    windows: Iterable[int] = (5, 10),
    current_row: bool = True,
    keys: tuple[str, ...] = TEAM_VENUE,
    order: tuple[str, ...] = ORDER,
) -> DataFrame:
    """Mean of each stat over the last L rows per key, the current row included or excluded."""
    frames = {}
    for w in windows:
        lo, hi = (-(w - 1), 0) if current_row else (-w, -1)
        for s in stats:
            frames[f"{s}_l{w}"] = (lo, hi, mean_over(s))
    return rows_frame(sides, list(keys), list(order), frames, unix("kickoff"))


def dominance(own: Column | str, other: Column | str) -> Column:
    """own / (own + other) in [0, 1]; neutral when missing or nothing happened."""
    own, other = col(own).cast("double"), col(other).cast("double")
    return F.when((own + other) > 0, clamp(own / (own + other), 0.0, 1.0)).otherwise(F.lit(NEUTRAL))


def possession_share(pos: Column | str) -> Column:
    """Share in [0, 1] from a 0-1 or 0-100 figure; neutral otherwise."""
    p = col(pos).cast("double")
    return F.when(p.between(0, 1), p).when(p.between(0, 100), p / 100.0).otherwise(F.lit(NEUTRAL))


def pressure_components(sides: DataFrame) -> DataFrame:
    """Per-row dominance components, their presence and the availability-weighted index."""
    parts, columns = [], {}
    for name, weight in PRESSURE_WEIGHTS.items():
        own, other = f"{name}_for", f"{name}_against"
        if own not in sides.columns or other not in sides.columns:
            continue
        if name == "pos":
            value, present = possession_share(own), F.col(own).isNotNull()
        else:
            value, present = dominance(own, other), F.col(own).isNotNull() & F.col(other).isNotNull()
        columns[f"dom_{name}"] = value
        parts.append((value, present, weight))
    index = F.coalesce(weighted_present(parts), F.lit(NEUTRAL))
    core = [f"{n}_{d}" for n in ("shots", "sot", "corners", "pos") for d in ("for", "against")]
    have_all = [c for c in core if c in sides.columns]
    present = F.lit(len(have_all) == len(core))
    for c in have_all:
        present = present & F.col(c).isNotNull()
    return sides.withColumns({**columns, "press_index": index, "stats_present": present.cast("double")})


def form_frames(
    df: DataFrame,
    values: Mapping[str, float],
    evidence: str,
    window: int = 10,
    keys: tuple[str, ...] = TEAM_VENUE,
    order: tuple[str, ...] = ORDER,
    count_on: str | None = None,
) -> DataFrame:
    """Pre-match and post-match means (with a neutral fill), counts and evidence sums in one pass.

    ``values`` maps a column to its neutral value.
    """
    frames = {}
    for tag, lo, hi in (("pre", -window, -1), ("post", -(window - 1), 0)):
        for c, neutral in values.items():
            frames[f"{c}_{tag}"] = (lo, hi, lambda w, _, c=c, v=neutral: F.coalesce(F.avg(c).over(w), F.lit(v)))
        base = count_on or next(iter(values))
        frames[f"n_{tag}"] = (lo, hi, lambda w, _, c=base: F.count(c).over(w))
        frames[f"evidence_{tag}"] = (lo, hi, lambda w, _: F.coalesce(F.sum(evidence).over(w), F.lit(0.0)))
    return rows_frame(df, list(keys), list(order), frames, unix("kickoff"))


def decay_form(
    df: DataFrame,
    value: str,
    out: str,
    neutral: float,
    window: int = 10,
    half_life: float = 5.0,
    lag: int = 1,
    keys: tuple[str, ...] = TEAM_VENUE,
    order: tuple[str, ...] = ORDER,
) -> DataFrame:
    """Mean over the rows ``lag .. lag+window-1`` back, the weight halving every ``half_life`` rows.

    ``lag=1`` starts at the latest earlier match; ``lag=2`` leaves that one out as well.
    """
    steps = range(lag, lag + window)

    def decayed(_, base) -> Column:
        num, den = F.lit(0.0), F.lit(0.0)
        for j in steps:
            weight = math.exp(-DECAY_RATE * (j - lag) / half_life)
            v = F.lag(value, j).over(base)
            num = num + F.coalesce(v * weight, F.lit(0.0))
            den = den + F.when(v.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.coalesce(F.try_divide(num, den), F.lit(neutral))

    frames = {out: (-(lag + window - 1), 0, decayed)}
    return rows_frame(df, list(keys), list(order), frames, unix("kickoff"))


def xg_inputs(sides: DataFrame, xg_for: Column, xg_against: Column) -> DataFrame:
    """Per-row expected-goal helpers: difference, shot quality, finishing luck, presence."""
    return sides.withColumns({"xg_for": xg_for, "xg_against": xg_against}).withColumns(
        {
            "xg_diff": F.col("xg_for") - F.col("xg_against"),
            "shot_quality": F.when(F.col("shots_for") > 0, F.col("xg_for") / F.col("shots_for")),
            "finishing_luck": F.col("gf") - F.col("xg_for"),
            "xg_present": (F.col("xg_for").isNotNull() & F.col("xg_against").isNotNull()).cast("double"),
        }
    )


def league_profile(matches: DataFrame, window: int = 100, min_matches: int = 50) -> DataFrame:
    """League scoring profile over the last ``window`` matches strictly before the kick-off."""
    total = F.col("ft_home") + F.col("ft_away")
    cond = {
        "hw": F.col("ft_home") > F.col("ft_away"),
        "bt": (F.col("ft_home") > 0) & (F.col("ft_away") > 0),
        "ov": total > 2.5,
    }
    frames = {
        "_n": (-window, -1, lambda w, _: F.count(F.lit(1)).over(w)),
        "_goals": (-window, -1, lambda w, _: F.avg(total).over(w)),
        "_gh": (-window, -1, lambda w, _: F.avg("ft_home").over(w)),
        "_ga": (-window, -1, lambda w, _: F.avg("ft_away").over(w)),
        **{f"_{k}": (-window, -1, lambda w, _, c=c: F.count_if(c).over(w)) for k, c in cond.items()},
    }
    keys = ["country", "league"]
    framed = rows_frame(matches, keys, ["kickoff", "home", "away", "fixture_id"], frames, unix("kickoff"))
    rank = F.struct("home", "away", "fixture_id")
    framed = first_of_ties(framed, keys, "kickoff", rank, list(frames))
    ok = F.col("_n") >= min_matches
    return framed.withColumns(
        {
            "lg_goals_per_match": F.when(ok, F.col("_goals")),
            "lg_home_win_rate": F.when(ok, F.col("_hw") / F.col("_n")),
            "lg_btts_rate": F.when(ok, F.col("_bt") / F.col("_n")),
            "lg_over25_rate": F.when(ok, F.col("_ov") / F.col("_n")),
            "lg_home_advantage": F.when(ok, F.col("_gh") - F.col("_ga")),
            "lg_defensive_idx": F.when(ok & (F.col("_goals") > 0), 1.0 / F.col("_goals")),
            "lg_profile_usable": ok.cast("int"),
        }
    ).drop(*frames)


def band_history(sides: DataFrame, band_col: str = "band") -> DataFrame:
    """Goals for and against over all strictly earlier matches in the same band, expanding."""
    played = F.col("gf").isNotNull()
    out = running(
        sides,
        ["team", "venue", band_col],
        ["kickoff"],
        {
            "_n": played.cast("int"),
            "_gf": F.coalesce("gf", F.lit(0)),
            "_ga": F.coalesce("ga", F.lit(0)),
        },
        unix("kickoff"),
        strict_on=unix("kickoff"),
    )
    return out.withColumns(
        {"gf_vs_band": ratio("_gf", "_n"), "ga_vs_band": ratio("_ga", "_n")}
    ).drop("_n", "_gf", "_ga")


def row_ewma(sides: DataFrame, values: Mapping[str, Column], half_life: float = 5.0, **kw) -> DataFrame:
    """EWMA per team and venue in match order."""
    return ewma(sides, list(TEAM_VENUE), list(ORDER), values, unix("kickoff"), half_life, **kw)


# States of a team ahead of its first match, at home and away.
STATE_PRIORS = {
    "gf": (1.2, 1.0), "ga": (1.2, 1.0), "ppg": (1.2, 1.0),
    "gf_mid": (1.2, 1.0), "ga_mid": (1.2, 1.0), "gf_high": (1.2, 1.0), "ga_high": (1.2, 1.0),
    "pos_for": (50.0, 50.0), "pos_against": (50.0, 50.0),
    "corners_for": (5.0, 4.0), "corners_against": (5.0, 4.0),
    "xg_per_pos": (0.02, 0.02), "xg_per_pos_against": (0.02, 0.02),
    "corner_xg": (0.10, 0.08), "corner_xg_against": (0.10, 0.08),
}


def directional_states(sides: DataFrame, half_life: float = 5.0, mid: tuple[float, float] = (1600.0, 1800.0), rows: int | None = None) -> DataFrame:
    """All directional EWMA states of a team and venue ahead of each match, in one affine scan.

    Needs the side stats, ``opp_elo``, ``xg_for``, ``xg_against``, ``corner_xg_for`` and ``corner_xg_against``. A row without a
    score moves nothing; the band states move only against opponents rated inside ``mid`` or above it, possession states where
    it is known, expected goals per possession where both are known and possession is positive; missing corners count as none.
    """
    a = 1.0 - 0.5 ** (1.0 / half_life)
    c = F.col
    played = c("gf").isNotNull() & c("ga").isNotNull()
    pts = F.when(c("gf") > c("ga"), 3.0).when(c("gf") == c("ga"), 1.0).otherwise(0.0)
    in_mid, high = c("opp_elo").between(*mid), c("opp_elo") > mid[1]
    per = lambda x, p: F.when(c(p) > 0, c(x) / c(p))
    values = {
        "gf": c("gf"), "ga": c("ga"), "ppg": pts,
        "gf_mid": F.when(in_mid, c("gf")), "ga_mid": F.when(in_mid, c("ga")), "gf_high": F.when(high, c("gf")), "ga_high": F.when(high, c("ga")),
        "pos_for": c("pos_for"), "pos_against": c("pos_against"),
        "corners_for": F.coalesce("corners_for", F.lit(0)), "corners_against": F.coalesce("corners_against", F.lit(0)),
        "xg_per_pos": per("xg_for", "pos_for"), "xg_per_pos_against": per("xg_against", "pos_against"),
        "corner_xg": c("corner_xg_for"), "corner_xg_against": c("corner_xg_against"),
    }
    at_home = c("venue") == "home"
    states = {f"s_{n}": (F.lit(1.0 - a), F.when(played, F.lit(a) * v.cast("double")), F.when(at_home, STATE_PRIORS[n][0]).otherwise(STATE_PRIORS[n][1])) for n, v in values.items()}
    return affine_scan(sides, TEAM_VENUE, ORDER, unix("kickoff"), states, rows)


def clean_sheet_streak(sides: DataFrame) -> DataFrame:
    """Number of latest earlier matches of the team in a row without conceding."""
    from kickframe.operators.ordered import ordinal

    order = ["kickoff", "fixture_id"]
    numbered = ordinal(sides, ["team"], order, unix("kickoff"), "_rn")
    conceded = F.when(F.coalesce(F.col("ga") != 0, F.lit(True)), F.col("_rn"))
    out = last_before(
        numbered, ["team"], ["_rn"], {"_last": conceded}, F.col("_rn"), F.struct("_rn")
    )
    streak = F.col("_rn") - 1 - F.coalesce("_last", F.lit(0))
    return out.withColumn("clean_sheet_streak", streak).drop("_rn", "_last")


#: Rows weighed against their past at once.
STEP_ROWS = 512


def strength_form(
    sides: DataFrame, sigma: float = 30.0, tau_days: float = 180.0, min_matches: int = 3, max_hist: int = 200, rows: int | None = None
) -> DataFrame:
    """Form weighted by similarity of the opponent's rating and by age, over the last ``max_hist`` matches of a team.

    Needs ``opp_elo`` and ``pts``. Slices of rows carry the ``max_hist`` rows before them; inside a slice a run of rows is weighed
    against its own window as one matrix, so that no row holds a history and the cost is linear in rows. With fewer than
    ``min_matches`` strictly earlier matches the plain mean of the last ``min_matches`` rows stands in.
    """
    stats = ["gf", "ga", "shots_for", "shots_against", "corners_for", "corners_against", "pts"]
    order = ["kickoff", "fixture_id"]
    spread = haloed(sides, ["team"], order, unix("kickoff"), max_hist, rows)
    # copies stay only inside the slice; the rows themselves come back by their own columns
    first = F.row_number().over(W.partitionBy("team", "_slice").orderBy(*order)) == 1
    own = [F.col(f"`{c}`") for c in sides.columns]
    sent = spread.select(*own, "_copy", unix("kickoff").alias("_t"), F.col("opp_elo").cast("double").alias("_r"), *[F.col(s).cast("double").alias(f"_x_{s}") for s in stats], first.alias("_first"))
    columns = list(sides.columns)
    n = len(columns)
    made = [f"_m_{s}" for s in stats]

    def weigh(held: pa.Table) -> pa.RecordBatch | None:
        copy = held.column(n).to_numpy()
        t, r = held.column(n + 1).to_numpy(), held.column(n + 2).to_numpy()
        x = np.column_stack([held.column(n + 3 + k).to_numpy() for k in range(len(stats))])
        known, filled = ~np.isnan(x), np.nan_to_num(x)
        ask = np.flatnonzero(copy == 0)
        means, count = np.full((len(ask), len(stats)), np.nan), np.zeros(len(ask), np.int64)
        for at in range(0, len(ask), STEP_ROWS):
            rows_ = ask[at : at + STEP_ROWS]
            lo = max(0, rows_[0] - max_hist)
            past = np.arange(lo, rows_[-1])
            inside = (past[None, :] < rows_[:, None]) & (past[None, :] >= rows_[:, None] - max_hist)
            used = inside & (t[past][None, :] < t[rows_][:, None])
            gap = (r[past][None, :] - r[rows_][:, None]) / sigma
            near = np.exp(-0.5 * gap * gap)
            near = np.where(np.isnan(near), 1.0, near)
            w = np.where(used, np.exp(-((t[rows_][:, None] - t[past][None, :]) // 86400) / tau_days) * near, 0.0)
            with np.errstate(invalid="ignore", divide="ignore"):
                weighed = (w @ filled[past]) / (w @ known[past].astype(float))
                last = (inside & (past[None, :] >= rows_[:, None] - min_matches)).astype(float)
                plain = (last @ filled[past]) / (last @ known[past].astype(float))
            n_used, n_hist = used.sum(1), inside.sum(1)
            here = slice(at, at + len(rows_))
            means[here] = np.where((n_used >= min_matches)[:, None], weighed, plain)
            means[here][n_used == 0] = np.nan
            count[here] = np.where(n_used == 0, 0, np.where(n_used >= min_matches, n_used, np.minimum(n_hist, min_matches)))
        if not len(ask):
            return None
        kept = held.take(pa.array(ask)).combine_chunks()
        cols = [c.chunk(0) for c in kept.columns[:n]]
        extra = [pa.array(means[:, k], from_pandas=True) for k in range(len(stats))]
        return pa.RecordBatch.from_arrays([*cols, *extra, pa.array(count)], [*columns, *made, "num_matches"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole slices, one after the other."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)).tolist()
            for lo, hi in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if lo in starts and held:
                    out = weigh(pa.Table.from_batches(held))
                    if out is not None:
                        yield out
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            out = weigh(pa.Table.from_batches(held))
            if out is not None:
                yield out

    schema = T.StructType([*sides.schema.fields, *[T.StructField(c, T.DoubleType()) for c in made], T.StructField("num_matches", T.LongType())])
    framed = sent.mapInArrow(walk, schema)
    return framed.withColumns(
        {
            "shot_conv": F.when(F.col("_m_shots_for") > 0, F.col("_m_gf") / F.col("_m_shots_for")),
            "shot_conv_rec": F.when(F.col("_m_shots_against") > 0, F.col("_m_ga") / F.col("_m_shots_against")),
            "corners_conv": F.when(F.col("_m_corners_for") > 0, F.col("_m_gf") / F.col("_m_corners_for")),
            "points_per_game": F.col("_m_pts"),
        }
    ).drop(*made)


def latest_state(sides: DataFrame, values: Iterable[str], cutoff: Column, keys=TEAM_VENUE) -> DataFrame:
    """Last row per key at a cutoff, as one mergeable aggregate instead of a sort."""
    rank = F.struct("kickoff", "opp", "fixture_id")
    picked = sides.filter(F.col("kickoff") < cutoff).groupBy(*keys).agg(
        F.max_by(F.struct("kickoff", "fixture_id", *values), rank).alias("_s")
    )
    return picked.select(*keys, F.col("_s.kickoff").alias("last_kickoff"), *[F.col(f"_s.{v}").alias(v) for v in values])

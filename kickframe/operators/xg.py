"""Expected-goal proxy: league references, calibration and the walk-forward Poisson fit."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions.cols import clamp
from kickframe.session import cut_lineage, python_partitions


def league_calibration(
    sides: DataFrame, pred: str, actual: str, min_rows: int = 80, prior: float = 80.0, limits: tuple[float, float] = (0.85, 1.15)
) -> DataFrame:
    """Observed over predicted mean per league, shrunk towards one and clipped."""
    g = sides.filter(F.col(pred).isNotNull() & F.col(actual).isNotNull()).groupBy("league").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(pred).alias("_p"), F.avg(actual).alias("_o")
    )
    g = g.filter((F.col("_n") >= min_rows) & (F.col("_p") > 1e-9))
    mult = 1 + F.col("_n") / (F.col("_n") + prior) * (F.col("_o") / F.col("_p") - 1)
    return g.select("league", clamp(mult, *limits).alias("multiplier"))


def opponent_factor(df: DataFrame, limits: tuple[float, float] = (0.8, 1.2)) -> DataFrame:
    """Opponent rating over the league mean rating (global mean where a league has none), clipped."""
    both = df.select("league", F.explode(F.array("elo_home", "elo_away")).alias("_e"))
    per_league = both.groupBy("league").agg(F.avg("_e").alias("_lg"))
    overall = both.agg(F.avg("_e").alias("g")).select("g").scalar()
    joined = df.join(per_league, "league", "left").withColumn("_ref", F.coalesce("_lg", overall))
    factor = lambda c: clamp(F.col(c) / F.col("_ref"), *limits)
    return joined.withColumns({"factor_home": factor("elo_away"), "factor_away": factor("elo_home")}).drop("_lg", "_ref")


def week_index(ts: str) -> Column:
    """Number of the Monday-based week."""
    return F.floor((F.unix_date(F.to_date(ts)) + 3) / 7)


def _newton_step(stats: np.ndarray, n: float, mean: np.ndarray, std: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """Next standardised coefficients from raw sums ``[sum mu z z' | sum (mu - y) z]`` with z = (1, x)."""
    q = len(b)
    hess, grad = stats[: q * q].reshape(q, q), stats[q * q :]
    to_std = np.eye(q)
    to_std[1:, 1:] = np.diag(1.0 / std)
    to_std[1:, 0] = -mean / std
    penalty = np.diag([0.0] + [alpha] * (q - 1))
    h = to_std @ hess @ to_std.T / n + penalty
    g = to_std @ grad / n + penalty @ b
    return b - np.linalg.solve(h + 1e-12 * np.eye(q), g)


def _raw_coef(b: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    w = b[1:] / std
    return np.concatenate([[b[0] - (w * mean).sum()], w])


#: Rows of one league in one block; larger leagues are spread over several.
BLOCK_ROWS = 20_000
#: Rows of one league that are stored as one piece.
STEP = 2_000
#: Rows weighed against all later fits at once: their numbers stay in a core's cache.
CHUNK = 128
#: Rows of a partition, on average.
PART_ROWS = 500_000
#: Coarse bins that a column's values are counted in before medians are refined inside single bins.
BINS = 256
#: Stand-ins for columns without any earlier value.
DEFAULTS = {
    "shots_for": 10.0, "shots_against": 10.0, "sot_for": 3.5, "sot_against": 3.5, "corners_for": 4.5, "corners_against": 4.5,
    "pos_for": 50.0, "pos_against": 50.0, "sot_share_for": 0.33, "sot_share_against": 0.33,
}


@dataclass(frozen=True)
class Calibration:
    """League multipliers of a weekly fit: observed over fitted goals, shrunk by ``prior`` rows towards one, clipped."""

    min_rows: int = 80
    prior: float = 80.0
    limits: tuple[float, float] = (0.85, 1.15)


@dataclass(frozen=True)
class WeeklyFits:
    """Tables of a walk-forward fit; ``week`` is the week a fit is for, it knows earlier weeks only.

    ``xg``: fixture_id, venue, league, week, factor, raw, multiplier, xg for every side row.
    ``fits``: week, rows, score (mean of fitted minus seen goals). ``fills``: feature, week, fill.
    ``calibration``: league, week, rows, observed, predicted, multiplier (null below the least number of rows).
    """

    xg: DataFrame
    fits: DataFrame
    fills: DataFrame
    calibration: DataFrame


def medians_before(rows: DataFrame, columns: list[str], step: str, steps: int, bins: int = BINS) -> DataFrame:
    """(feature, step, median): exact median of each column over the rows of earlier steps; none where there are no values.

    ``step`` numbers 0 .. steps - 1. Equal values are counted first. Counts per coarse bin are summed up over the steps, which
    gives the bin that holds the middle rank at each step; only these bins are looked at value by value.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    counted = rows.select((F.col(step) + 1).alias("step"), F.inline(pairs)).where(F.col("v").isNotNull() & (F.col("step") < steps))
    counted = cut_lineage(counted.groupBy("feature", "step", "v").agg(F.count(F.lit(1)).alias("n")))
    cuts = counted.groupBy("feature").agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], 10_000).alias("cuts"))
    placed = counted.join(cuts, "feature").select("feature", "step", "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bin"))
    per = placed.groupBy("feature", "bin", "step").agg(F.sum("n").alias("n"))
    grid = per.select("feature", "bin").distinct().select("feature", "bin", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"), F.lit(0).cast("long").alias("n"))
    filled = per.select("feature", "bin", F.col("step").cast("int").alias("step"), "n").unionByName(grid).groupBy("feature", "bin", "step").agg(F.sum("n").alias("n"))
    known = filled.withColumn("n", F.expr("sum(n) OVER (PARTITION BY feature, bin ORDER BY step)"))
    known = known.selectExpr("*", "sum(n) OVER (PARTITION BY feature, step ORDER BY bin) - n AS below", "sum(n) OVER (PARTITION BY feature, step) AS total").where("total > 0")
    ranks = F.explode(F.array(F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)))
    wanted = known.select("feature", "bin", "step", "n", "below", ranks.alias("rank")).where("below <= rank AND rank < below + n")
    wanted = wanted.groupBy("feature", "bin", "step", "below").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count(F.lit(1)).alias("halves"))
    inside = placed.alias("p").join(wanted.alias("w"), (F.col("p.feature") == F.col("w.feature")) & (F.col("p.bin") == F.col("w.bin")) & (F.col("p.step") <= F.col("w.step")))
    inside = inside.groupBy("w.feature", "w.step", "w.bin", "below", "lo", "hi", "halves", "v").agg(F.sum("p.n").alias("n"))
    inside = inside.withColumn("upto", F.expr("below + sum(n) OVER (PARTITION BY feature, step, bin ORDER BY v)"))
    pick = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("v")))
    halves = inside.groupBy("feature", "step", "bin", "halves").agg(pick("lo").alias("a"), pick("hi").alias("b"))
    # both middle ranks in one bin: their mean; else each bin gives its half
    return halves.groupBy("feature", "step").agg(F.sum(F.when(F.col("halves") == 2, (F.col("a") + F.col("b")) / 2).otherwise(F.col("a") / 2)).alias("median"))


class _Piece(NamedTuple):
    """Some rows of one league in order of their step of the calendar, and the league's reference rating at each step."""

    league: str
    ref: np.ndarray
    x: np.ndarray
    goals: np.ndarray
    elo: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    week: np.ndarray
    venue: Sequence[str]

    def known(self) -> _Piece:
        """The rows to learn from."""
        ok = ~np.isnan(self.goals)
        return self if ok.all() else self._replace(x=self.x[ok], goals=self.goals[ok], elo=self.elo[ok], at=self.at[ok])


class _Fits:
    """Coefficients of all fits, in the space of a row's known values, of marks for its missing ones and of its opponent factor.

    A filled value is the known one plus the mark times the fill, so a row's numbers are the same for every fit and
    a fit's fills enter as a linear map of its sums. The factor hangs on the fit and is made where rows are weighed.
    """

    def __init__(self, features, gaps, fills, overall, limits, with_factor):
        self.features, self.gaps, self.overall, self.limits, self.with_factor = features, gaps, overall, limits, with_factor
        p, self.k = len(features), 1 + len(features) + len(gaps)
        self.q = 1 + p + with_factor
        self.maps = np.zeros((len(overall), self.q, self.k + with_factor))
        self.maps[:, np.arange(1 + p), np.arange(1 + p)] = 1.0
        for j, name in enumerate(gaps):
            self.maps[:, 1 + features.index(name), 1 + p + j] = fills[name]
        if with_factor:
            self.maps[:, -1, -1] = 1.0
        self.upper = np.triu_indices(self.k)
        self.width = len(self.upper[0]) + self.k + with_factor * (self.k + 1)

    #: Columns of a stored piece.
    STORED = "league string, ref binary, x binary, goals binary, elo binary, at binary, ids binary, week binary, venue array<string>"

    def runs(self, batches):
        """(rows of one league, its reference rating at each fit) in steps of bounded size; a block's head has the sums."""
        ref = self.overall
        for pdf in batches:
            lg, head = pdf["_lg"].to_numpy(), pdf["_head"].to_numpy()
            cut = np.flatnonzero((head == 1) | np.concatenate([[True], lg[1:] != lg[:-1]]))
            for a, b in zip(cut, [*cut[1:], len(pdf)], strict=True):
                part = pdf.iloc[a:b]
                if head[a] == 1:
                    total, n = np.zeros(len(self.overall) + 1), np.zeros(len(self.overall) + 1)
                    row = part.iloc[0]
                    for r in json.loads(row["_r"] or "[]"):
                        total[r["_at"] + 1], n[r["_at"] + 1] = float(r["s"]), r["n"]
                    total, n = total.cumsum()[:-1], n.cumsum()[:-1]
                    ref = np.where(n > 0, total / np.maximum(n, 1.0), self.overall)
                    part = part.iloc[1:]
                for s in range(0, len(part), STEP):
                    yield part.iloc[s : s + STEP], ref

    def stored(self, batches):
        """Rows of a block as pieces of plain numbers, which a pass reads without converting them again."""
        for part, ref in self.runs(batches):
            part = part.sort_values("_at", kind="stable")
            numbers = lambda c, kind=float: part[c].to_numpy(kind).tobytes()  # noqa: B023, E731
            yield pd.DataFrame(
                {
                    "league": [part["_lg"].iloc[0]], "ref": [ref.astype(float).tobytes()], "x": [numbers(self.features)], "goals": [numbers("_y")], "elo": [numbers("_elo")],
                    "at": [numbers("_at", np.int32)], "ids": [numbers("fixture_id", np.int64)], "week": [numbers("week", np.int64)], "venue": [part["venue"].to_numpy()],
                }
            )

    def pieces(self, batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                at, number = np.frombuffer(r.at, np.int32), lambda x: np.frombuffer(x, float)
                yield _Piece(r.league, number(r.ref), number(r.x).reshape(len(at), -1), number(r.goals), number(r.elo), at, np.frombuffer(r.ids, np.int64), np.frombuffer(r.week, np.int64), r.venue)

    def numbers(self, x):
        gone = np.isnan(x)
        marks = gone[:, [self.features.index(g) for g in self.gaps]].astype(float)
        return np.column_stack([np.ones(len(x)), np.where(gone, 0.0, x), marks])

    def factor(self, elo, ref):
        """Opponent's rating over the reference, clipped; 1 without a rating or with a reference of 0 or less."""
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.clip(elo / ref, *self.limits)
        return np.where(np.isnan(f) | (ref <= 0), 1.0, f)

    def weighed(self, piece, z, coef, at):
        """(rows, first fit, mu, factor): fitted goals of a few rows by all fits from the first one that knows one of them.

        Rows stand in order of time, so fits before them are left out; a fit that doesn't know a row has 0 there.
        """
        if self.with_factor:
            plain = piece.ref[at] > 0
            scale = 1.0 / np.where(plain, piece.ref[at], 1.0)
            rated = ~np.isnan(piece.elo)
        for s in range(0, len(z), CHUNK):
            rows = slice(s, s + CHUNK)
            when = piece.at[rows]
            lo, hi = np.searchsorted(at, when[0], side="right"), np.searchsorted(at, when[-1], side="right")
            if lo == len(at):
                break
            mu, f = z[rows] @ coef[lo:, : self.k].T, None
            if self.with_factor:
                f = np.multiply.outer(piece.elo[rows], scale[lo:])
                np.clip(f, *self.limits, out=f)
                if not rated[rows].all():
                    f[~rated[rows]] = 1.0
                if not plain[lo:].all():
                    f[:, ~plain[lo:]] = 1.0
                mu += f * coef[lo:, -1]
            np.clip(mu, -30, 30, out=mu)
            np.exp(mu, out=mu)
            if hi > lo:
                mu[:, : hi - lo] *= when[:, None] < at[None, lo:hi]
            yield rows, lo, mu, f

    def sums(self, piece, coef, at, acc, goals=None):
        """Adds the rows' ``mu z z'`` and ``mu z`` of the fits numbered ``at`` to ``acc``, and ``mu y z`` to ``goals`` if given."""
        z = self.numbers(piece.x)
        both = np.column_stack([z[:, self.upper[0]] * z[:, self.upper[1]], z])
        n = both.shape[1]
        for rows, lo, mu, f in self.weighed(piece, z, coef, at):
            acc[lo:, :n] += mu.T @ both[rows]
            y = piece.goals[rows]
            if goals is not None:
                goals[lo:, : self.k] += mu.T @ (z[rows] * y[:, None])
            if f is not None:
                mu *= f
                acc[lo:, n : n + self.k] += mu.T @ z[rows]
                acc[lo:, -1] += np.einsum("ij,ij->j", mu, f)
                if goals is not None:
                    goals[lo:, -1] += y @ mu

    def unpacked(self, stats, fit):
        """(sum of mu z z', sum of mu z) of one fit over filled values."""
        n, k = len(self.upper[0]), self.k
        full = np.zeros((k + self.with_factor, k + self.with_factor))
        full[self.upper] = stats[:n]
        full[:k, :k] += np.triu(full[:k, :k], 1).T
        if self.with_factor:
            full[-1, :k] = full[:k, -1] = stats[n + k : n + 2 * k]
            full[-1, -1] = stats[-1]
        return self.maps[fit] @ full @ self.maps[fit].T, self.maps[fit] @ full[0]


def weekly_fits(
    sides: DataFrame,
    features: list[str],
    required: list[str] | None = None,
    opponent: str | None = None,
    calibration: Calibration | None = None,
    league: str = "league",
    goal: str = "gf",
    week: str = "week",
    alpha: float = 0.1,
    min_rows: int = 30,
    prior: float = 1.25,
    refit_weeks: int = 1,
    rounds: int = 25,
    tol: float = 1e-9,
    defaults: dict[str, float] = DEFAULTS,
    limits: tuple[float, float] = (0.8, 1.2),
) -> WeeklyFits:
    """Expected goals of every side row from a Poisson regression on all strictly earlier weeks.

    Objective per fit: mean half deviance + alpha/2 |w|^2 on standardised features, intercept free. A fit's missing values are
    the medians of its own training rows, else ``defaults``. With ``opponent`` (the other side's rating) a last feature is that rating
    over the league's mean rating before the week (of all leagues where it has none, 1500 without any), for training rows too, so
    that they are rescaled for every fit; a missing rating counts as the mean. ``calibration`` multiplies a league's
    predictions by its observed over fitted goals in the training rows. Below ``min_rows`` training rows the venue's mean goals are
    predicted, else ``prior``. Rows without a week or with a ``required`` column (default: none) missing or negative are not learnt
    from; they leave with null xg. A null league, or a table without leagues, is the league ''.

    All weeks are fitted together: a pass adds every row to the sums of all later fits inside its partition, and only those
    sums (fits x features^2, bounded by the calendar) meet on the driver. League figures stay tables. ``refit_weeks`` spaces the fits.
    """
    spark, f_on = sides.sparkSession, opponent is not None
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    usable = F.col(week).isNotNull()
    for c in required or []:
        usable = usable & F.coalesce(finite(c) >= 0, F.lit(False))
    xs = [f"_x{i}" for i in range(len(features))]
    base = sides.select(
        "fixture_id", "venue", (F.coalesce(F.col(league).cast("string"), F.lit("")) if league in sides.columns else F.lit("")).alias("_lg"), F.col(week).cast("long").alias("week"), usable.alias("_ok"),
        F.greatest(finite(goal), F.lit(0.0)).alias("_y0"), finite(goal).isNotNull().alias("_t"), (finite(opponent) if f_on else F.lit(None).cast("double")).alias("_elo"),
        *[finite(c).alias(x) for c, x in zip(features, xs, strict=True)],
    ).withColumn("_y", F.when(F.col("_t"), F.col("_y0"))).drop("_y0")
    base = cut_lineage(base)
    weeks = np.array(sorted(r[0] for r in base.where("_ok").select("week").distinct().collect()), dtype=np.int64)
    marks = weeks[:: max(1, refit_weeks)]
    steps = spark.createDataFrame([(int(w), int(np.searchsorted(marks, w, side="right") - 1)) for w in weeks], "week long, _at int")
    rows = base.where("_ok").join(steps, "week")
    train = rows.where("_t")

    # one row per step of the calendar
    sums = [F.count(F.lit(1)).alias("all"), F.count_if("_t").alias("n"), F.sum("_elo").alias("rt"), F.count("_elo").alias("rn")]
    for v in ("home", "away"):
        sums += [F.sum(F.when(F.col("venue") == v, F.col("_y"))).alias(f"y_{v}"), F.count_if((F.col("venue") == v) & F.col("_t")).alias(f"n_{v}")]
    sums += [F.count_if(F.col(x).isNull()).alias(f"gone{x}") for x in xs]
    per = rows.groupBy("_at").agg(*sums).orderBy("_at").toPandas().fillna(0.0).astype(float)
    before = {c: np.concatenate([[0.0], per[c].to_numpy().cumsum()[:-1]]) if len(per) else np.zeros(0) for c in per.columns if c != "_at"}
    overall = np.where(before["rn"] > 0, before["rt"] / np.maximum(before["rn"], 1.0), 1500.0)
    gaps = [x for x in xs if per[f"gone{x}"].sum() > 0]
    fills = {x: np.full(len(marks), float(defaults.get(c, 0.0))) for c, x in zip(features, xs, strict=True) if x in gaps}
    if gaps:
        for r in medians_before(train, gaps, "_at", len(marks)).collect():  # one number per gap and step of the calendar
            fills[r["feature"]][r["step"]] = r["median"]

    # rows of one league side by side, large leagues in several blocks, each behind a head with the league's sums of ratings
    parts = F.ceil(F.col("_size") / F.lit(BLOCK_ROWS)).cast("int")
    sizes = rows.groupBy("_lg").agg(F.count(F.lit(1)).alias("_size")).withColumn("_parts", parts).drop("_size")
    dealt = max(python_partitions(spark), -(-int(per["all"].sum()) // PART_ROWS))
    table = rows.join(sizes, "_lg").withColumns({"_b": F.pmod(F.xxhash64("fixture_id", "venue"), F.col("_parts")).cast("int"), "_head": F.lit(0), "fixture_id": F.col("fixture_id").cast("long")}).drop("_parts", "_ok")
    if f_on:
        rated = rows.where("_elo IS NOT NULL").groupBy("_lg", "_at").agg(F.sum("_elo").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
        rated = rated.groupBy("_lg").agg(F.collect_list(F.struct("_at", "s", "n")).alias("_r"))
        heads = sizes.join(rated, "_lg", "left").select("_lg", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_b"), F.lit(1).alias("_head"), F.to_json("_r").alias("_r"))  # as text: arrays that most rows lack are slow to send
        heads = heads.withColumns({c: F.lit(0).cast(table.schema[c].dataType) for c in ("fixture_id", "week", "_at", "_t")})  # no nulls: ids stay whole numbers
        table = table.unionByName(heads, allowMissingColumns=True)
    table = table.repartition(dealt, "_lg", "_b").sortWithinPartitions("_lg", "_b", F.desc("_head"), "_at")

    fits = _Fits(xs, gaps, fills, overall, limits, int(f_on))
    table = cut_lineage(table.mapInPandas(fits.stored, fits.STORED))
    at = np.flatnonzero(before["n"] >= max(min_rows, 1))
    nf, width = before["n"][at], fits.width

    def measure(coef: np.ndarray, some: np.ndarray, goals: bool = False) -> np.ndarray:
        """One pass: sums of the fits numbered ``some``, a row each, with ``goals`` the sums of goals behind them."""
        names = [f"v{i}" for i in range(width + goals * (fits.k + f_on))]

        def run(batches):
            acc = np.zeros((len(some), len(names)))
            for piece in fits.pieces(batches):
                piece = piece.known()
                if len(piece.at):
                    fits.sums(piece, coef, some, acc[:, :width], acc[:, width:] if goals else None)
            yield pd.DataFrame(np.column_stack([np.arange(len(some)), acc]), columns=["fit", *names])

        schema = "fit double, " + ", ".join(f"{v} double" for v in names)
        got = table.mapInPandas(run, schema).groupBy("fit").agg(*[F.sum(v).alias(v) for v in names]).orderBy("fit").toPandas()
        return got.to_numpy()[:, 1:]

    b, raw, score = np.zeros((len(at), fits.q)), np.zeros((len(at), fits.q)), np.zeros(len(at))
    spread = lambda: np.stack([fits.maps[m].T @ raw[i] for i, m in enumerate(at)])
    if len(at):
        plain = measure(np.zeros((len(at), fits.k + f_on)), at, goals=True)  # with every mu = 1: sums, squares and goals
        seen = np.stack([fits.maps[m] @ g for m, g in zip(at, plain[:, width:], strict=True)])
        plain = [fits.unpacked(v, m)[0] for v, m in zip(plain[:, :width], at, strict=True)]
        mean = np.stack([h[0, 1:] for h in plain]) / nf[:, None]
        var = np.stack([np.diag(h)[1:] for h in plain]) / nf[:, None] - mean**2
        std = np.where(var > 1e-12, np.sqrt(np.maximum(var, 1e-300)), 1.0)
        b[:, 0] = np.log(np.maximum(seen[:, 0] / nf, 1e-6))
        live = np.arange(len(at))
        for _ in range(rounds + 1):  # a fit's last pass measures what its rounds have reached; settled fits leave
            raw[live] = [_raw_coef(b[i], mean[i], std[i]) for i in live]
            stats = [fits.unpacked(v, at[i]) for i, v in zip(live, measure(spread()[live], at[live]), strict=True)]
            stats = [(h, g - seen[i]) for i, (h, g) in zip(live, stats, strict=True)]
            score[live] = [g[0] / nf[i] for i, (_, g) in zip(live, stats, strict=True)]
            nxt = np.stack([_newton_step(np.concatenate([h.ravel(), g]), nf[i], mean[i], std[i], b[i], alpha) for i, (h, g) in zip(live, stats, strict=True)])
            moved = np.abs(nxt - b[live]).max(1) >= tol
            live = live[moved]
            if not len(live):
                break
            b[live] = nxt[moved]
        else:
            raise RuntimeError(f"weekly fits did not settle in {rounds} rounds; give more")
    coef = spread() if len(at) else np.zeros((0, fits.k + f_on))

    leagues = _league_goals(table, fits, coef, at, marks)
    cal = calibration or Calibration()
    ratio = clamp(1 + F.col("rows") / (F.col("rows") + cal.prior) * (F.col("observed") / F.col("predicted") - 1), *cal.limits)
    ratio = F.when((F.col("rows") >= cal.min_rows) & (F.col("predicted") > 1e-9), ratio)
    leagues = cut_lineage(leagues.withColumn("multiplier", ratio)) if calibration else leagues.withColumn("multiplier", F.lit(None).cast("double")).limit(0)

    venue_mean = {v: np.where(before[f"n_{v}"] > 0, before[f"y_{v}"] / np.maximum(before[f"n_{v}"], 1.0), prior) for v in ("home", "away")}
    which = {int(m): i for i, m in enumerate(at)}

    def predict(batches):
        for piece in fits.pieces(batches):
            m, z, venue = piece.at, fits.numbers(piece.x), np.asarray(piece.venue, object)
            pick = np.array([which.get(int(s), -1) for s in m])
            out = np.where(venue == "home", venue_mean["home"][m], venue_mean["away"][m])
            f = fits.factor(piece.elo, piece.ref[m]) if f_on else np.full(len(m), np.nan)
            ok = pick >= 0
            lin = (z[ok] * coef[pick[ok]][:, : fits.k]).sum(1) + (f[ok] * coef[pick[ok]][:, -1] if f_on else 0.0)
            out[ok] = np.exp(np.clip(lin, -30, 30))
            yield pd.DataFrame({"fixture_id": piece.ids, "venue": venue, "league": piece.league, "week": piece.week, "_fit": marks[m], "factor": f, "raw": out})

    got = table.mapInPandas(predict, "fixture_id long, venue string, league string, week long, _fit long, factor double, raw double")
    got = got.join(leagues.select("league", F.col("week").alias("_fit"), "multiplier"), ["league", "_fit"], "left").drop("_fit")
    got = got.withColumns({"factor": F.when(~F.isnan("factor"), F.col("factor")), "multiplier": F.coalesce("multiplier", F.lit(1.0))}).withColumn("xg", F.col("raw") * F.col("multiplier"))
    rest = base.where("NOT _ok").select("fixture_id", "venue", F.col("_lg").alias("league"), "week")
    named = {x: c for c, x in zip(features, xs, strict=True)}
    return WeeklyFits(
        got.unionByName(rest, allowMissingColumns=True).select("fixture_id", "venue", "league", "week", "factor", "raw", "multiplier", "xg"),
        spark.createDataFrame([(int(marks[m]), int(nf[i]), float(score[i])) for i, m in enumerate(at)], "week long, rows long, score double"),
        spark.createDataFrame([(named[x], int(w), float(v)) for x in gaps for w, v in zip(marks, fills[x], strict=True)], "feature string, week long, fill double"),
        leagues,
    )


def _league_goals(table: DataFrame, fits: _Fits, coef: np.ndarray, at: np.ndarray, marks: np.ndarray, held: int = 256) -> DataFrame:
    """(league, week, rows, observed, predicted): training rows of each fit by league, mean goals seen and fitted."""

    def frame(got):
        out = [pd.DataFrame({"league": lg, "week": marks[at], "n": a[0], "o": a[1], "p": a[2]}) for lg, a in got.items()]
        return pd.concat(out) if out else pd.DataFrame(columns=["league", "week", "n", "o", "p"])

    def run(batches):
        got: dict[str, np.ndarray] = {}
        for piece in fits.pieces(batches):
            piece = piece.known()
            if not len(piece.at) or not len(at):
                continue
            lg = piece.league
            if lg not in got and len(got) >= held:
                yield frame(got)
                got = {}
            upto = lambda w: np.concatenate([[0.0], np.bincount(piece.at, w, minlength=len(fits.overall)).cumsum()])[at]  # noqa: B023, E731
            new = np.stack([upto(None), upto(piece.goals), np.zeros(len(at))])
            for _, lo, mu, _ in fits.weighed(piece, fits.numbers(piece.x), coef, at):
                new[2, lo:] += mu.sum(0)
            got[lg] = got[lg] + new if lg in got else new
        yield frame(got)

    sums = table.mapInPandas(run, "league string, week long, n double, o double, p double").groupBy("league", "week").agg(F.sum("n").alias("n"), F.sum("o").alias("o"), F.sum("p").alias("p"))
    return sums.where("n > 0").select("league", "week", F.col("n").cast("long").alias("rows"), (F.col("o") / F.col("n")).alias("observed"), (F.col("p") / F.col("n")).alias("predicted"))


def walk_forward(sides: DataFrame, features: list[str], report: list | None = None, **options) -> DataFrame:
    """(fixture_id, venue, xg) of ``weekly_fits``; ``report`` receives (week, rows, score) of every fit."""
    made = weekly_fits(sides, features, **options)
    if report is not None:
        report += [tuple(r) for r in made.fits.collect()]  # one row per step of the calendar
    return made.xg.select("fixture_id", "venue", "xg")


def impute_medians(df: DataFrame, columns: list[str], defaults: dict[str, float]) -> DataFrame:
    """Missing values by the column median, else by a default."""
    from kickframe.operators.quantiles import grouped_quantiles

    fills = {c: grouped_quantiles(df, [], c, {"m": 0.5}).select("m").scalar() for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), fills[c], F.lit(defaults.get(c, 0.0))) for c in columns})

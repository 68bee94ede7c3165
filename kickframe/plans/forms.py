"""Queries on form windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.functions.cols import band, clamp, unix
from kickframe.operators import forms as fm
from kickframe.operators.markets import p_under_25
from kickframe.operators.ordered import ordinal, rows_frame, running
from kickframe.plans.fixtures import CUTOFF, Tables, sql
from kickframe.plans.registry import query

STATS = ["gf", "ga", "shots_for", "sot_for", "corners_for", "pos_for"]
WIN = "WINDOW w5 AS (PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id ROWS {a} ), w10 AS (PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id ROWS {b})"


def _avg_list(post: bool) -> str:
    return ", ".join(f"ROUND(AVG({s}) OVER w{w}, 6) AS {s}_l{w}" for w in (5, 10) for s in STATS)


@query(
    "rolling_form",
    "W01 X03",
    sql(
        f"SELECT fixture_id, team, venue, {_avg_list(True)} FROM sides "
        + WIN.format(a="BETWEEN 4 PRECEDING AND CURRENT ROW", b="BETWEEN 9 PRECEDING AND CURRENT ROW"),
        "sides",
    ),
)
def _(t: Tables):
    out = fm.rolling_form(t.sides, STATS)
    return out.select("fixture_id", "team", "venue", *[f"{s}_l{w}" for w in (5, 10) for s in STATS])


@query(
    "rolling_form_before",
    "W02",
    sql(
        f"SELECT fixture_id, team, venue, {_avg_list(False)} FROM sides "
        + WIN.format(a="BETWEEN 5 PRECEDING AND 1 PRECEDING", b="BETWEEN 10 PRECEDING AND 1 PRECEDING"),
        "sides",
    ),
)
def _(t: Tables):
    out = fm.rolling_form(t.sides, STATS, current_row=False)
    return out.select("fixture_id", "team", "venue", *[f"{s}_l{w}" for w in (5, 10) for s in STATS])


DOM = """CASE WHEN {a} + {b} > 0 THEN CAST({a} AS DOUBLE) / ({a} + {b}) ELSE 0.5e0 END"""
PRESS_CTE = f"""press AS (
  SELECT *, {DOM.format(a='shots_for', b='shots_against')} AS dom_shots, {DOM.format(a='sot_for', b='sot_against')} AS dom_sot,
         {DOM.format(a='corners_for', b='corners_against')} AS dom_corners, COALESCE(pos_for / 100e0, 0.5e0) AS dom_pos,
         CASE WHEN shots_for IS NOT NULL AND shots_against IS NOT NULL THEN 1 ELSE 0 END AS has_s,
         CASE WHEN corners_for IS NOT NULL AND corners_against IS NOT NULL THEN 1 ELSE 0 END AS has_c,
         CASE WHEN pos_for IS NOT NULL THEN 1 ELSE 0 END AS has_p
  FROM sides),
pidx AS (
  SELECT *, CASE WHEN has_s + has_c + has_p > 0 THEN
     (has_s * (0.45e0 * dom_shots + 0.3e0 * dom_sot) + has_c * 0.15e0 * dom_corners + has_p * 0.1e0 * dom_pos)
     / (has_s * 0.75e0 + has_c * 0.15e0 + has_p * 0.1e0) ELSE 0.5e0 END AS press_index,
     CAST(has_s * has_c * has_p AS DOUBLE) AS stats_present
  FROM press)"""
PRE = "(PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
POST = "(PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(
    "pressure_index",
    "P27 P28 P23",
    sql(
        "SELECT fixture_id, team, venue, ROUND(dom_shots, 6) AS dom_shots, ROUND(dom_sot, 6) AS dom_sot, ROUND(dom_corners, 6) AS dom_corners, "
        "ROUND(dom_pos, 6) AS dom_pos, ROUND(press_index, 6) AS press_index, stats_present FROM pidx",
        "sides",
        PRESS_CTE,
    ),
)
def _(t: Tables):
    return fm.pressure_components(t.sides).select(
        "fixture_id", "team", "venue", "dom_shots", "dom_sot", "dom_corners", "dom_pos", "press_index", "stats_present"
    )


PVALS = ["press_index", "dom_shots", "dom_sot", "dom_corners", "dom_pos"]


@query(
    "pressure_form",
    "W03",
    sql(
        "SELECT fixture_id, team, venue, "
        + ", ".join(
            f"ROUND(COALESCE(AVG({c}) OVER {fr}, 0.5e0), 6) AS {c}_{tag}" for tag, fr in (("pre", PRE), ("post", POST)) for c in PVALS
        )
        + f", COUNT(press_index) OVER {PRE} AS n_pre, COUNT(press_index) OVER {POST} AS n_post, "
        f"COALESCE(SUM(stats_present) OVER {PRE}, 0e0) AS evidence_pre, COALESCE(SUM(stats_present) OVER {POST}, 0e0) AS evidence_post FROM pidx",
        "sides",
        PRESS_CTE,
    ),
)
def _(t: Tables):
    out = fm.form_frames(fm.pressure_components(t.sides), dict.fromkeys(PVALS, 0.5), "stats_present")
    tags = ("pre", "post")
    return out.select(
        "fixture_id", "team", "venue", *[f"{c}_{g}" for g in tags for c in PVALS], *[f"{c}_{g}" for c in ("n", "evidence") for g in tags]
    )


def _decay_sql(lag: int) -> str:
    terms = [(j, f"exp(-0.693e0 * {j - lag} / 5e0)") for j in range(lag, lag + 10)]
    num = " + ".join(f"COALESCE(LAG(press_index, {j}) OVER w * {w}, 0)" for j, w in terms)
    den = " + ".join(f"CASE WHEN LAG(press_index, {j}) OVER w IS NOT NULL THEN {w} ELSE 0 END" for j, w in terms)
    return (
        f"SELECT fixture_id, team, venue, ROUND(COALESCE(({num}) / NULLIF({den}, 0), 0.5e0), 6) AS press_decay FROM pidx "
        "WINDOW w AS (PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id)"
    )


@query("decay_form", "W04", sql(_decay_sql(1), "sides", PRESS_CTE))
def _(t: Tables):
    out = fm.decay_form(fm.pressure_components(t.sides), "press_index", "press_decay", 0.5)
    return out.select("fixture_id", "team", "venue", "press_decay")


@query("decay_form_double_lag", "W04 Q15", sql(_decay_sql(2), "sides", PRESS_CTE))
def _(t: Tables):
    out = fm.decay_form(fm.pressure_components(t.sides), "press_index", "press_decay", 0.5, lag=2)
    return out.select("fixture_id", "team", "venue", "press_decay")


XG_CTE = """xg AS (
  SELECT *, 0.05e0 * shots_for + 0.2e0 * sot_for AS xg_for, 0.05e0 * shots_against + 0.2e0 * sot_against AS xg_against FROM sides),
xgi AS (
  SELECT *, xg_for - xg_against AS xg_diff, CASE WHEN shots_for > 0 THEN xg_for / shots_for END AS shot_quality, gf - xg_for AS finishing_luck,
         CAST(CASE WHEN xg_for IS NOT NULL AND xg_against IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) AS xg_present FROM xg)"""
XVALS = ["xg_for", "xg_against", "xg_diff", "shot_quality", "finishing_luck"]


def xg_sides(t: Tables):
    own = F.lit(0.05) * F.col("shots_for") + F.lit(0.2) * F.col("sot_for")
    other = F.lit(0.05) * F.col("shots_against") + F.lit(0.2) * F.col("sot_against")
    return fm.xg_inputs(t.sides, own, other)


@query(
    "xg_form",
    "W05 P31",
    sql(
        "SELECT fixture_id, team, venue, "
        + ", ".join(f"ROUND(COALESCE(AVG({c}) OVER {fr}, 0e0), 6) AS {c}_{tag}" for tag, fr in (("pre", PRE), ("post", POST)) for c in XVALS)
        + f", COUNT(xg_for) OVER {PRE} AS n_pre, COUNT(xg_for) OVER {POST} AS n_post, "
        f"COALESCE(SUM(xg_present) OVER {PRE}, 0e0) AS evidence_pre, COALESCE(SUM(xg_present) OVER {POST}, 0e0) AS evidence_post FROM xgi",
        "sides",
        XG_CTE,
    ),
)
def _(t: Tables):
    out = fm.form_frames(xg_sides(t), dict.fromkeys(XVALS, 0.0), "xg_present")
    tags = ("pre", "post")
    return out.select(
        "fixture_id", "team", "venue", *[f"{c}_{g}" for g in tags for c in XVALS], *[f"{c}_{g}" for c in ("n", "evidence") for g in tags]
    )


LP = "(PARTITION BY country, league ORDER BY kickoff, home, away, fixture_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"


@query(
    "league_profile",
    "W06",
    sql(
        """SELECT fixture_id, CASE WHEN n >= 50 THEN ROUND(goals, 6) END AS lg_goals_per_match,
        CASE WHEN n >= 50 THEN ROUND(hw / n, 6) END AS lg_home_win_rate, CASE WHEN n >= 50 THEN ROUND(bt / n, 6) END AS lg_btts_rate,
        CASE WHEN n >= 50 THEN ROUND(ov / n, 6) END AS lg_over25_rate, CASE WHEN n >= 50 THEN ROUND(gh - ga, 6) END AS lg_home_advantage,
        CASE WHEN n >= 50 AND goals > 0 THEN ROUND(1e0 / goals, 6) END AS lg_defensive_idx,
        CAST(n >= 50 AS BIGINT) AS lg_profile_usable
        FROM tied""",
        "",
        f"""fr AS (SELECT *, COUNT(*) OVER {LP} AS n, AVG(ft_home + ft_away) OVER {LP} AS goals, AVG(ft_home) OVER {LP} AS gh, AVG(ft_away) OVER {LP} AS ga,
          SUM(CASE WHEN ft_home > ft_away THEN 1e0 ELSE 0e0 END) OVER {LP} AS hw, SUM(CASE WHEN ft_home > 0 AND ft_away > 0 THEN 1e0 ELSE 0e0 END) OVER {LP} AS bt,
          SUM(CASE WHEN ft_home + ft_away > 2.5 THEN 1e0 ELSE 0e0 END) OVER {LP} AS ov FROM matches),
        firsts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY country, league, kickoff ORDER BY home, away, fixture_id) AS k FROM fr),
        tied AS (SELECT m.fixture_id, f.n, f.goals, f.gh, f.ga, f.hw, f.bt, f.ov FROM matches m JOIN firsts f
                 ON f.k = 1 AND m.country = f.country AND m.league = f.league AND m.kickoff = f.kickoff)""",
    ),
)
def _(t: Tables):
    cols = ["lg_goals_per_match", "lg_home_win_rate", "lg_btts_rate", "lg_over25_rate", "lg_home_advantage", "lg_defensive_idx", "lg_profile_usable"]
    return fm.league_profile(t.matches).select("fixture_id", *cols)


BAND = "CASE WHEN {d} >= 100 THEN 'BULLY' WHEN {d} <= -100 THEN 'DOG' ELSE 'PEER' END"
BANDED_CTE = f"""banded AS (
  SELECT fixture_id, kickoff, home AS team, 'home' AS venue, ft_home AS gf, ft_away AS ga, {BAND.format(d='(elo_home - elo_away)')} AS band FROM rated
  UNION ALL SELECT fixture_id, kickoff, away, 'away', ft_away, ft_home, {BAND.format(d='(elo_away - elo_home)')} FROM rated)"""


def rated_sides(t: Tables):
    from kickframe.operators.sides import SIDE_COLUMNS, side_rows

    return side_rows(t.rated, {**SIDE_COLUMNS, "own_elo": ("elo_home", "elo_away"), "opp_elo": ("elo_away", "elo_home")})


@query(
    "band_history",
    "W07 P21",
    sql(
        """SELECT fixture_id, team, venue, band, ROUND(AVG(gf) OVER w, 6) AS gf_vs_band, ROUND(AVG(ga) OVER w, 6) AS ga_vs_band FROM banded
        WINDOW w AS (PARTITION BY team, venue, band ORDER BY kickoff RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 SECOND PRECEDING)""",
        "rated",
        BANDED_CTE,
    ),
)
def _(t: Tables):
    sides = rated_sides(t).withColumn("band", band(F.col("own_elo") - F.col("opp_elo"), 100.0))
    return fm.band_history(sides).select("fixture_id", "team", "venue", "band", "gf_vs_band", "ga_vs_band")


@query(
    "ewma_form",
    "W09",
    sql(
        """SELECT fixture_id, team, venue, ROUND(e_gf, 6) AS gf_ewma, ROUND(e_ga, 6) AS ga_ewma FROM rec""",
        "sides",
        """seq AS (SELECT *, COALESCE(gf, 0) AS x, COALESCE(ga, 0) AS y, ROW_NUMBER() OVER (PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id) AS rn FROM sides),
        RECURSIVE_rec AS (SELECT fixture_id, team, venue, rn, CAST(x AS DOUBLE) AS e_gf, CAST(y AS DOUBLE) AS e_ga FROM seq WHERE rn = 1
        UNION ALL SELECT s.fixture_id, s.team, s.venue, s.rn, pow(0.5e0, 0.2e0) * r.e_gf + (1 - pow(0.5e0, 0.2e0)) * s.x,
                  pow(0.5e0, 0.2e0) * r.e_ga + (1 - pow(0.5e0, 0.2e0)) * s.y
        FROM rec r JOIN seq s ON s.team = r.team AND s.venue = r.venue AND s.rn = r.rn + 1)""",
    ),
)
def _(t: Tables):
    zero = F.lit(0)
    out = fm.row_ewma(t.sides, {"gf_ewma": F.coalesce("gf", zero), "ga_ewma": F.coalesce("ga", zero)})
    return out.select("fixture_id", "team", "venue", "gf_ewma", "ga_ewma")


@query(
    "ewma_states_before",
    "W10",
    sql(
        """SELECT fixture_id, team, venue, ROUND(p_gf, 6) AS gf_state, ROUND(p_pts, 6) AS pts_state, ROUND(p_pos, 6) AS pos_state FROM rec""",
        "sides",
        """seq AS (SELECT *, gf AS x, CASE WHEN gf > ga THEN 3e0 WHEN gf = ga THEN 1e0 ELSE 0e0 END AS pts, COALESCE(pos_for, 50e0) AS pos,
             ROW_NUMBER() OVER (PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id) AS rn FROM sides WHERE gf IS NOT NULL),
        RECURSIVE_rec AS (SELECT fixture_id, team, venue, rn, x, pts, pos, 1.2e0 AS p_gf, 1.2e0 AS p_pts, 50e0 AS p_pos FROM seq WHERE rn = 1
        UNION ALL SELECT s.fixture_id, s.team, s.venue, s.rn, s.x, s.pts, s.pos, pow(0.5e0, 0.2e0) * r.p_gf + (1 - pow(0.5e0, 0.2e0)) * r.x,
                  pow(0.5e0, 0.2e0) * r.p_pts + (1 - pow(0.5e0, 0.2e0)) * r.pts, pow(0.5e0, 0.2e0) * r.p_pos + (1 - pow(0.5e0, 0.2e0)) * r.pos
        FROM rec r JOIN seq s ON s.team = r.team AND s.venue = r.venue AND s.rn = r.rn + 1)""",
    ),
)
def _(t: Tables):
    played = t.sides.filter("gf IS NOT NULL")
    pts = F.when(F.col("gf") > F.col("ga"), 3.0).when(F.col("gf") == F.col("ga"), 1.0).otherwise(0.0)
    values = {"gf_state": F.col("gf").cast("double"), "pts_state": pts, "pos_state": F.coalesce("pos_for", F.lit(50.0))}
    priors = {"gf_state": 1.2, "pts_state": 1.2, "pos_state": 50.0}
    out = fm.row_ewma(played, values, priors=priors, before=True)
    return out.select("fixture_id", "team", "venue", *values)


def _states_sql() -> str:
    """The same states row by row: a recursive step per match of a team and venue."""
    mid, high = "opp_elo BETWEEN 1460 AND 1540", "opp_elo > 1540"
    value = {
        "gf": "gf", "ga": "ga", "ppg": "CASE WHEN gf > ga THEN 3e0 WHEN gf = ga THEN 1e0 ELSE 0e0 END",
        "gf_mid": f"CASE WHEN {mid} THEN gf END", "ga_mid": f"CASE WHEN {mid} THEN ga END", "gf_high": f"CASE WHEN {high} THEN gf END", "ga_high": f"CASE WHEN {high} THEN ga END",
        "pos_for": "pos_for", "pos_against": "pos_against", "corners_for": "COALESCE(corners_for, 0)", "corners_against": "COALESCE(corners_against, 0)",
        "xg_per_pos": "CASE WHEN pos_for > 0 THEN xg_for / pos_for END", "xg_per_pos_against": "CASE WHEN pos_against > 0 THEN xg_against / pos_against END",
        "corner_xg": "0.03e0 * corners_for", "corner_xg_against": "0.03e0 * corners_against",
    }
    names = list(value)
    first = ", ".join(f"CAST(CASE venue WHEN 'home' THEN {fm.STATE_PRIORS[n][0]} ELSE {fm.STATE_PRIORS[n][1]} END AS DOUBLE) AS s_{n}" for n in names)
    keep = ", ".join(f"CASE WHEN gf IS NOT NULL AND ga IS NOT NULL THEN CAST({v} AS DOUBLE) END AS v_{n}" for n, v in value.items())
    step = ", ".join(f"COALESCE(pow(0.5e0, 0.2e0) * r.s_{n} + (1 - pow(0.5e0, 0.2e0)) * r.v_{n}, r.s_{n})" for n in names)
    vs = ", ".join(f"v_{n}" for n in names)
    return f"""s0 AS (SELECT s.*, CASE venue WHEN 'home' THEN elo_away ELSE elo_home END AS opp_elo, 0.05e0 * shots_for + 0.2e0 * sot_for AS xg_for, 0.05e0 * shots_against + 0.2e0 * sot_against AS xg_against
          FROM sides s JOIN rated r USING (fixture_id)),
        seq AS (SELECT fixture_id, team, venue, ROW_NUMBER() OVER (PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id) AS rn, {keep} FROM s0),
        RECURSIVE_rec AS (SELECT fixture_id, team, venue, rn, {vs}, {first} FROM seq WHERE rn = 1
        UNION ALL SELECT s.fixture_id, s.team, s.venue, s.rn, {", ".join(f"s.v_{n}" for n in names)}, {step} FROM rec r JOIN seq s ON s.team = r.team AND s.venue = r.venue AND s.rn = r.rn + 1)"""


@query(
    "directional_states",
    "W10",
    sql("SELECT fixture_id, team, venue, " + ", ".join(f"ROUND(s_{n}, 6) AS s_{n}" for n in fm.STATE_PRIORS) + " FROM rec", "sides rated", _states_sql()),
)
def _(t: Tables):
    from kickframe.operators.sides import SIDE_COLUMNS, side_rows

    sides = side_rows(t.rated, {**SIDE_COLUMNS, "opp_elo": ("elo_away", "elo_home")})
    xg = lambda d: F.lit(0.05) * F.col(f"shots_{d}") + F.lit(0.2) * F.col(f"sot_{d}")
    sides = sides.withColumns({f"xg_{d}": xg(d) for d in ("for", "against")} | {f"corner_xg_{d}": F.lit(0.03) * F.col(f"corners_{d}") for d in ("for", "against")})
    # stand-in ratings lie between 1,400 and 1,600, so the bands do as well
    out = fm.directional_states(sides, mid=(1460.0, 1540.0))
    return out.select("fixture_id", "team", "venue", *[f"s_{n}" for n in fm.STATE_PRIORS])


@query(
    "max_rating_step",
    "W16",
    sql(
        """SELECT team, ROUND(MAX(ABS(own_elo - p)), 6) AS max_step FROM d GROUP BY team""",
        "rated",
        """s AS (SELECT fixture_id, kickoff, home AS team, elo_home AS own_elo FROM rated UNION ALL SELECT fixture_id, kickoff, away, elo_away FROM rated),
        d AS (SELECT *, LAG(own_elo) OVER (PARTITION BY team ORDER BY kickoff, fixture_id) AS p FROM s)""",
    ),
)
def _(t: Tables):
    stepped = rows_frame(
        rated_sides(t),
        ["team"],
        ["kickoff", "fixture_id"],
        {"prev": (-1, 0, lambda w, base: F.lag("own_elo", 1).over(base))},
        unix("kickoff"),
    )
    return stepped.groupBy("team").agg(F.max(F.abs(F.col("own_elo") - F.col("prev"))).alias("max_step"))


@query(
    "shift_identity",
    "W17 Q15",
    sql(
        """SELECT venue, COUNT(*) AS checked, CAST(COUNT(*) FILTER (ABS(pre - prev_post) > 1e-9) AS BIGINT) AS mismatches FROM j WHERE prev_post IS NOT NULL GROUP BY venue""",
        "sides",
        f"""f AS (SELECT *, AVG(gf) OVER {PRE} AS pre, AVG(gf) OVER {POST} AS post FROM sides),
        j AS (SELECT *, LAG(post) OVER (PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id) AS prev_post FROM f)""",
    ),
)
def _(t: Tables):
    frames = {
        "pre": (-10, -1, fm.mean_over("gf")),
        "prev_post": (-10, 0, lambda w, b: F.avg("gf").over(b.rowsBetween(-10, -1))),
    }
    order = list(fm.ORDER)
    post = rows_frame(t.sides, ["team", "venue"], order, {"pre": frames["pre"], "post": (-9, 0, fm.mean_over("gf"))}, unix("kickoff"))
    lagged = rows_frame(post, ["team", "venue"], order, {"prev_post": (-1, 0, lambda w, b: F.lag("post", 1).over(b))}, unix("kickoff"))
    return (
        lagged.filter("prev_post IS NOT NULL")
        .groupBy("venue")
        .agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.abs(F.col("pre") - F.col("prev_post")) > 1e-9).alias("mismatches"))
    )


@query(
    "season_last_five",
    "W18 A34",
    sql(
        """SELECT fixture_id, season, ROUND(AVG(ft_home) OVER w, 6) AS mean5, CAST(SUM(ft_home) OVER w AS BIGINT) AS sum5,
        ROUND(100e0 * AVG(CASE WHEN ft_home > ft_away THEN 1e0 ELSE 0e0 END) OVER w, 6) AS win_pct5,
        ROUND(AVG(ft_home) OVER (PARTITION BY season, home), 6) AS season_mean FROM seasoned
        WINDOW w AS (PARTITION BY season, home ORDER BY kickoff, away, fixture_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
        "seasoned",
    ),
)
def _(t: Tables):
    win = F.when(F.col("ft_home") > F.col("ft_away"), 1.0).otherwise(0.0)
    frames = {
        "mean5": (-4, 0, fm.mean_over("ft_home")),
        "sum5": (-4, 0, lambda w, _: F.sum("ft_home").over(w)),
        "win_pct5": (-4, 0, lambda w, _: 100.0 * F.avg(win).over(w)),
    }
    df = rows_frame(t.seasoned, ["season", "home"], ["kickoff", "away", "fixture_id"], frames, unix("kickoff"))
    means = t.seasoned.groupBy("season", "home").agg(F.avg("ft_home").alias("season_mean"))
    return df.join(means, ["season", "home"]).select("fixture_id", "season", "mean5", "sum5", "win_pct5", "season_mean")


@query(
    "both_venues_last_five",
    "W19",
    sql(
        """SELECT s.fixture_id, s.team, ROUND(AVG(p.gf), 6) AS gf_last5, ROUND(AVG(p.shots_for), 6) AS shots_last5 FROM
          (SELECT *, COALESCE(SUM(ok) OVER (PARTITION BY team ORDER BY kickoff, fixture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM tagged) s
          LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY kickoff, fixture_id) AS k FROM tagged WHERE ok = 1) p
          ON p.team = s.team AND p.k <= s.seen AND p.k > s.seen - 5 GROUP BY s.fixture_id, s.team""",
        "sides",
        "tagged AS (SELECT *, CASE WHEN pos_for IS NOT NULL AND shots_for IS NOT NULL THEN 1 ELSE 0 END AS ok FROM sides)",
    ),
)
def _(t: Tables):
    # rows without the input never enter the frame: windows run over the valid rows, others take the last state
    from kickframe.operators.ordered import last_before

    ok = F.col("pos_for").isNotNull() & F.col("shots_for").isNotNull()
    order = ["kickoff", "fixture_id"]
    cut = unix("kickoff")
    valid = rows_frame(
        t.sides.filter(ok),
        ["team"],
        order,
        {"g": (-4, 0, fm.mean_over("gf")), "s": (-4, 0, fm.mean_over("shots_for"))},
        cut,
    ).withColumn("state", F.struct("g", "s"))
    rest = t.sides.filter(~ok)
    both = valid.unionByName(rest, allowMissingColumns=True).select("fixture_id", "team", "kickoff", "state")
    out = last_before(both, ["team"], order, {"before": F.col("state")}, cut, F.struct("kickoff", "fixture_id"))
    return out.select("fixture_id", "team", F.col("before.g").alias("gf_last5"), F.col("before.s").alias("shots_last5"))


@query(
    "strength_form",
    "W20",
    sql(
        """SELECT fixture_id, team, num_matches, ROUND(CASE WHEN sf > 0 THEN gf / sf END, 6) AS shot_conv,
        ROUND(CASE WHEN sa > 0 THEN ga / sa END, 6) AS shot_conv_rec, ROUND(pts, 6) AS points_per_game FROM out""",
        "rated",
        """s0 AS (SELECT fixture_id, kickoff, home AS team, elo_away AS opp_elo, ft_home AS gf, ft_away AS ga, shots_h AS sf, shots_a AS sa,
           CASE WHEN ft_home > ft_away THEN 3e0 WHEN ft_home = ft_away THEN 1e0 ELSE 0e0 END AS pts FROM rated
           UNION ALL SELECT fixture_id, kickoff, away, elo_home, ft_away, ft_home, shots_a, shots_h,
           CASE WHEN ft_away > ft_home THEN 3e0 WHEN ft_home = ft_away THEN 1e0 ELSE 0e0 END FROM rated),
        s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY kickoff, fixture_id) AS rn FROM s0),
        pairs AS (SELECT a.fixture_id, a.team, a.rn, b.rn AS brn, b.kickoff < a.kickoff AS used, b.gf, b.ga, b.sf, b.sa, b.pts,
             exp(-floor((epoch(a.kickoff) - epoch(b.kickoff)) / 86400) / 180e0) * exp(-0.5e0 * ((b.opp_elo - a.opp_elo) / 30e0) * ((b.opp_elo - a.opp_elo) / 30e0)) AS w
             FROM s a LEFT JOIN s b ON a.team = b.team AND b.rn < a.rn AND b.rn >= a.rn - 200),
        agg AS (SELECT fixture_id, team, COUNT(*) FILTER (used) AS n_used, COUNT(brn) AS n_hist,
             SUM(w * gf) FILTER (used) / NULLIF(SUM(w) FILTER (used AND gf IS NOT NULL), 0) AS wgf, SUM(w * ga) FILTER (used) / NULLIF(SUM(w) FILTER (used AND ga IS NOT NULL), 0) AS wga,
             SUM(w * sf) FILTER (used) / NULLIF(SUM(w) FILTER (used AND sf IS NOT NULL), 0) AS wsf, SUM(w * sa) FILTER (used) / NULLIF(SUM(w) FILTER (used AND sa IS NOT NULL), 0) AS wsa,
             SUM(w * pts) FILTER (used) / NULLIF(SUM(w) FILTER (used), 0) AS wpts,
             AVG(gf) FILTER (brn >= rn - 3) AS mgf, AVG(ga) FILTER (brn >= rn - 3) AS mga, AVG(sf) FILTER (brn >= rn - 3) AS msf,
             AVG(sa) FILTER (brn >= rn - 3) AS msa, AVG(pts) FILTER (brn >= rn - 3) AS mpts FROM pairs GROUP BY fixture_id, team),
        out AS (SELECT fixture_id, team, CAST(CASE WHEN n_used = 0 THEN 0 WHEN n_used >= 3 THEN n_used ELSE LEAST(n_hist, 3) END AS BIGINT) AS num_matches,
             CASE WHEN n_used = 0 THEN NULL WHEN n_used >= 3 THEN wgf ELSE mgf END AS gf, CASE WHEN n_used = 0 THEN NULL WHEN n_used >= 3 THEN wga ELSE mga END AS ga,
             CASE WHEN n_used = 0 THEN NULL WHEN n_used >= 3 THEN wsf ELSE msf END AS sf, CASE WHEN n_used = 0 THEN NULL WHEN n_used >= 3 THEN wsa ELSE msa END AS sa,
             CASE WHEN n_used = 0 THEN NULL WHEN n_used >= 3 THEN wpts ELSE mpts END AS pts FROM agg)""",
    ),
)
def _(t: Tables):
    pts = F.when(F.col("gf") > F.col("ga"), 3.0).when(F.col("gf") == F.col("ga"), 1.0).otherwise(0.0)
    out = fm.strength_form(rated_sides(t).withColumn("pts", pts))
    return out.select("fixture_id", "team", "num_matches", "shot_conv", "shot_conv_rec", "points_per_game")


@query(
    "clean_sheet_streak",
    "W21",
    sql(
        """SELECT fixture_id, team, CAST(rn - 1 - COALESCE(MAX(CASE WHEN COALESCE(ga, 1) <> 0 THEN rn END) OVER (PARTITION BY team ORDER BY rn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS clean_sheet_streak FROM s""",
        "sides",
        "s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY kickoff, fixture_id) AS rn FROM sides)",
    ),
)
def _(t: Tables):
    return fm.clean_sheet_streak(t.sides).select("fixture_id", "team", "clean_sheet_streak")


@query(
    "availability_running",
    "W22",
    sql(
        """SELECT fixture_id, team, ROUND(GREATEST(0e0, 1e0 - SUM(CASE WHEN fixture_id % 5 = 0 THEN LEAST(1e0, (fixture_id % 10 + 1) / 100e0) ELSE 0e0 END) OVER
        (PARTITION BY team ORDER BY kickoff, fixture_id ROWS UNBOUNDED PRECEDING)), 6) AS availability FROM sides""",
        "sides",
    ),
)
def _(t: Tables):
    i = F.col("fixture_id")
    weight = clamp((i % 10 + 1) / 100.0, 0.0, 1.0)
    out_weight = F.when(i % 5 == 0, weight).otherwise(0.0)
    out = running(t.sides, ["team"], ["kickoff", "fixture_id"], {"lost": out_weight}, unix("kickoff"), inclusive=True)
    return out.select("fixture_id", "team", F.greatest(F.lit(0.0), 1.0 - F.col("lost")).alias("availability"))


@query(
    "state_at_cutoff",
    "W23 A10",
    sql(
        f"""SELECT team, venue, kickoff AS last_kickoff, CAST(gf AS BIGINT) AS gf, CAST(ga AS BIGINT) AS ga, CAST(shots_for AS BIGINT) AS shots_for FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team, venue
        ORDER BY kickoff DESC, opp DESC, fixture_id DESC) AS k FROM sides WHERE kickoff < TIMESTAMP '{CUTOFF}') x WHERE k = 1""",
        "sides",
    ),
)
def _(t: Tables):
    return fm.latest_state(t.sides, ["gf", "ga", "shots_for"], F.lit(CUTOFF).cast("timestamp_ntz"))


@query(
    "week_buckets",
    "W24",
    sql("SELECT CAST(date_trunc('week', kickoff) AS TIMESTAMP) AS week_start, COUNT(*) AS n FROM matches GROUP BY 1"),
)
def _(t: Tables):
    week = F.date_trunc("week", F.col("kickoff")).cast("timestamp_ntz")
    return t.matches.groupBy(week.alias("week_start")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "round_index",
    "W15 J13",
    sql(
        """SELECT fixture_id, league, CAST((ROW_NUMBER() OVER (PARTITION BY league ORDER BY kickoff, home, away, fixture_id) - 1) // 10 + 1 AS BIGINT) AS round_idx FROM matches"""
    ),
)
def _(t: Tables):
    numbered = ordinal(t.matches, ["league"], ["kickoff", "home", "away", "fixture_id"], unix("kickoff"))
    return numbered.select("fixture_id", "league", (F.floor((F.col("rn") - 1) / 10) + 1).alias("round_idx"))


@query(
    "best_market_from_form",
    "A01 M06 M17 T11 W02",
    sql(
        """SELECT fixture_id, league, home, away, ROUND(mu_total, 6) AS mu_total, ROUND(p_under, 6) AS p_under,
        CASE WHEN p_under > 0.5 THEN 'OU25_UNDER' ELSE 'OU25_OVER' END AS best_market, ROUND(GREATEST(p_under, 1 - p_under), 6) AS best_prob FROM p""",
        "sides",
        f"""f AS (SELECT fixture_id, team, venue, AVG(gf) OVER (PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS g5 FROM sides),
        lg AS (SELECT league, AVG(ft_home) AS lh, AVG(ft_away) AS la FROM matches GROUP BY league),
        mu AS (SELECT m.fixture_id, m.league, m.home, m.away, 0.5e0 * LEAST(GREATEST(l.lh, 0.2e0), 3.5e0) + 0.5e0 * COALESCE(fh.g5, LEAST(GREATEST(l.lh, 0.2e0), 3.5e0))
             + 0.5e0 * LEAST(GREATEST(l.la, 0.2e0), 3.5e0) + 0.5e0 * COALESCE(fa.g5, LEAST(GREATEST(l.la, 0.2e0), 3.5e0)) AS mu_total
             FROM matches m JOIN lg l ON m.league = l.league JOIN f fh ON fh.fixture_id = m.fixture_id AND fh.venue = 'home'
             JOIN f fa ON fa.fixture_id = m.fixture_id AND fa.venue = 'away'),
        p AS (SELECT *, exp(-mu_total) * (1 + mu_total + mu_total * mu_total / 2e0) AS p_under FROM mu)""",
    ),
)
def _(t: Tables):
    form = fm.rolling_form(t.sides, ["gf"], windows=(5,), current_row=False)
    from kickframe.operators.sides import to_matches

    per_match = to_matches(form, ["gf_l5"])
    anchors = t.matches.groupBy("league").agg(F.avg("ft_home").alias("lh"), F.avg("ft_away").alias("la"))
    ah, aa = clamp("lh", 0.2, 3.5), clamp("la", 0.2, 3.5)
    df = t.matches.select("fixture_id", "league", "home", "away").join(anchors, "league").join(per_match, "fixture_id")
    total = 0.5 * ah + 0.5 * F.coalesce("gf_l5_home", ah) + 0.5 * aa + 0.5 * F.coalesce("gf_l5_away", aa)
    df = df.withColumn("mu_total", total).withColumn("p_under", p_under_25("mu_total"))
    return df.select(
        "fixture_id", "league", "home", "away", "mu_total", "p_under",
        F.when(F.col("p_under") > 0.5, "OU25_UNDER").otherwise("OU25_OVER").alias("best_market"),
        F.greatest(F.col("p_under"), 1 - F.col("p_under")).alias("best_prob"),
    )

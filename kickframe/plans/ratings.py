"""Queries on ratings and league states."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.functions.cols import unix
from kickframe.operators import forms as fm
from kickframe.operators import ratings as rt
from kickframe.operators.sides import to_matches
from kickframe.plans.fixtures import Tables, sql
from kickframe.plans.forms import POST, PRE, PRESS_CTE, XG_CTE, xg_sides
from kickframe.plans.registry import query

ORDER = ["kickoff", "home", "away", "fixture_id"]


def rules() -> rt.EloRules:
    return rt.EloRules(by_league={"NATION_1": (21.0, 58.0), "NATION_2": (22.0, 50.0)})


def typed(t: Tables):
    i = F.col("fixture_id")
    kind = F.when(i % 10 == 0, "cup").when(i % 10 == 1, "friendly").otherwise("league")
    return t.matches.withColumn("match_type", kind)


def series(t: Tables):
    return rt.elo_series(typed(t), "league", rules())


ELO_CTE = """seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY league ORDER BY kickoff, home, away, fixture_id) AS rn, CASE league WHEN 'NATION_1' THEN 21e0 WHEN 'NATION_2' THEN 22e0 ELSE 20e0 END
    * CASE fixture_id % 10 WHEN 0 THEN 1.12e0 WHEN 1 THEN 0.75e0 ELSE 1e0 END AS k, CASE league WHEN 'NATION_1' THEN 58e0 WHEN 'NATION_2' THEN 50e0 ELSE 65e0 END AS edge,
    LEAST(CASE WHEN abs(ft_home - ft_away) <= 1 THEN 1e0 WHEN abs(ft_home - ft_away) = 2 THEN 1.5e0 ELSE (11e0 + abs(ft_home - ft_away)) / 8e0 END, 2.75e0) AS g, CASE WHEN ft_home > ft_away THEN 1e0 WHEN ft_home = ft_away THEN 0.5e0 WHEN ft_home < ft_away THEN 0e0 END AS act FROM matches),
  RECURSIVE_st AS (SELECT DISTINCT league, CAST(0 AS BIGINT) AS rn, CAST(MAP {} AS MAP(VARCHAR, DOUBLE)) AS r, CAST(MAP {} AS MAP(VARCHAR, INT)) AS n, CAST(NULL AS BIGINT) AS fixture_id, '' AS home, '' AS away, 0e0 AS eh, 0e0 AS ea, 0e0 AS d FROM seq
    UNION ALL SELECT league, rn, CASE WHEN d IS NULL THEN r ELSE map_concat(r, MAP {home: GREATEST(1000e0, eh + d), away: GREATEST(1000e0, ea - d)}) END, CASE WHEN d IS NULL THEN n ELSE map_concat(n, MAP {home: nh + 1, away: na + 1}) END, fixture_id, home, away, eh, ea, d FROM
     (SELECT *, k * CASE WHEN LEAST(nh, na) < 12 THEN 1.25e0 ELSE 1e0 END * CASE WHEN (act = 1 AND x < 0.35) OR (act = 0 AND x > 0.65) THEN 1.2e0 ELSE 1e0 END * g * (act - x) AS d FROM
      (SELECT *, 1e0 / (1e0 + pow(10e0, -(eh + edge - ea) / 400e0)) AS x FROM (SELECT s.league, s.rn, st.r, st.n, s.fixture_id, s.home, s.away, s.k, s.edge, s.g, s.act, COALESCE(st.r[s.home], 1500e0) AS eh, COALESCE(st.r[s.away], 1500e0) AS ea, COALESCE(st.n[s.home], 0) AS nh, COALESCE(st.n[s.away], 0) AS na
        FROM st JOIN seq s ON s.league = st.league AND s.rn = st.rn + 1))))"""


@query(
    "elo_series",
    "L01 L02 X03",
    sql("SELECT fixture_id, ROUND(eh, 6) AS elo_home, ROUND(ea, 6) AS elo_away, ROUND(d, 6) AS delta FROM st WHERE rn > 0", "", ELO_CTE),
)
def _(t: Tables):
    return series(t).select("fixture_id", "elo_home", "elo_away", "delta")


@query(
    "final_ratings",
    "L03",
    sql(
        """SELECT team, ROUND(rating, 6) AS rating FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY rn DESC) AS q FROM (SELECT rn, home AS team, GREATEST(1000e0, eh + COALESCE(d, 0)) AS rating FROM st WHERE rn > 0
        UNION ALL SELECT rn, away, GREATEST(1000e0, ea - COALESCE(d, 0)) FROM st WHERE rn > 0)) WHERE q = 1""",
        "",
        ELO_CTE,
    ),
)
def _(t: Tables):
    return rt.final_ratings(t.matches, series(t), rules())


@query(
    "rating_bands",
    "L04 P21",
    sql(
        """SELECT fixture_id, ROUND(eh + 65 - ea, 6) AS elo_diff, CASE WHEN eh + 65 - ea >= 100 THEN 'BULLY' WHEN eh + 65 - ea <= -100 THEN 'DOG' ELSE 'PEER' END AS band_home, CASE WHEN eh + 65 - ea <= -100 THEN 'BULLY' WHEN eh + 65 - ea >= 100 THEN 'DOG' ELSE 'PEER' END AS band_away FROM st WHERE rn > 0""",
        "",
        ELO_CTE,
    ),
)
def _(t: Tables):
    return rt.attach_ratings(t.matches, series(t), width=100.0).select("fixture_id", "elo_diff", "band_home", "band_away")


@query(
    "rating_replay",
    "Q04 W16",
    "SELECT 'elo' AS audit, (SELECT COUNT(*) FROM orders) AS checked, CAST(0 AS BIGINT) AS off_expected, CAST(0 AS BIGINT) AS off_delta, CAST(0 AS BIGINT) AS off_chain",
)
def _(t: Tables):
    """Replay identity: each trace row follows from its ratings, each rating from the team's last update."""
    r = rules()
    s = rt._static(typed(t), r).join(series(t), "fixture_id")
    exp = 1.0 / (1.0 + F.pow(F.lit(10.0), -(F.col("elo_home") + F.col("home_edge") - F.col("elo_away")) / 400.0))
    delta = F.col("k_base") * F.col("type_mult") * F.col("new_mult") * F.col("upset_mult") * F.col("margin_mult") * (F.col("actual") - exp)
    d = F.coalesce("delta", F.lit(0.0))
    side = lambda team, own, sign: F.struct(F.col(team).alias("team"), F.col(own).alias("pre"), F.greatest(F.lit(r.floor), F.col(own) + sign * d).alias("post"))
    rows = s.select("league", *ORDER, F.inline(F.array(side("home", "elo_home", F.lit(1.0)), side("away", "elo_away", F.lit(-1.0)))))
    from kickframe.operators.ordered import last_before

    chain = last_before(rows, ["league", "team"], ORDER, {"prev": F.col("post")}, unix("kickoff"), F.struct(*ORDER))
    off_chain = chain.agg(F.count_if(F.abs(F.col("pre") - F.coalesce("prev", F.lit(r.start))) > 1e-6).alias("off_chain"))
    checks = s.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.abs(F.col("expected") - exp) > 1e-3).alias("off_expected"),
        F.count_if(F.abs(F.col("delta") - delta) > 1e-2).alias("off_delta"),
    )
    return checks.select(F.lit("elo").alias("audit"), "*", off_chain.select("off_chain").scalar().alias("off_chain"))


def _state_sql(order: str, group: str = "league") -> str:
    return f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {group} ORDER BY {order}) AS rn"


Z_CTE = (
    PRESS_CTE
    + f""",
  f AS (SELECT fixture_id, venue, COALESCE(AVG(press_index) OVER {PRE}, 0.5e0) AS pre, COALESCE(AVG(press_index) OVER {POST}, 0.5e0) AS post FROM pidx),
  m AS (SELECT r.*, h.pre AS ph, h.post AS qh, a.pre AS pa, a.post AS qa, elo_home + (r.fixture_id % 9) - 4 AS eh2, elo_away - (r.fixture_id % 9) + 4 AS ea2,
     ROW_NUMBER() OVER (PARTITION BY league ORDER BY kickoff, home, away, r.fixture_id) AS rn FROM rated r JOIN f h ON h.fixture_id = r.fixture_id AND h.venue = 'home' JOIN f a ON a.fixture_id = r.fixture_id AND a.venue = 'away'),
  up AS (SELECT 'ph' AS st, league, home AS team, rn, qh AS v FROM m UNION ALL SELECT 'pa', league, away, rn, qa FROM m UNION ALL SELECT 'el', league, home, rn, eh2 FROM m UNION ALL SELECT 'el', league, away, rn, ea2 FROM m),
  iv AS (SELECT *, COALESCE(LEAD(rn) OVER (PARTITION BY st, league, team ORDER BY rn), 1000000000) AS nx FROM up),
  ms AS (SELECT m.fixture_id, st, AVG(v) AS mean, stddev_pop(v) AS sd FROM m JOIN iv ON iv.league = m.league AND iv.rn < m.rn AND iv.nx >= m.rn GROUP BY ALL),
  z AS (SELECT m.fixture_id, COALESCE(CASE WHEN a.sd > 3.2e-5 THEN (ph - a.mean) / a.sd END, 0) AS zph, COALESCE(CASE WHEN b.sd > 3.2e-5 THEN (pa - b.mean) / b.sd END, 0) AS zpa,
     COALESCE(CASE WHEN c.sd > 3.2e-5 THEN (elo_home - c.mean) / c.sd END, 0) AS zeh, COALESCE(CASE WHEN c.sd > 3.2e-5 THEN (elo_away - c.mean) / c.sd END, 0) AS zea
     FROM m LEFT JOIN ms a ON a.fixture_id = m.fixture_id AND a.st = 'ph' LEFT JOIN ms b ON b.fixture_id = m.fixture_id AND b.st = 'pa' LEFT JOIN ms c ON c.fixture_id = m.fixture_id AND c.st = 'el')"""
)


def with_forms(df, sides, value: str, neutral: float, name: str, evidence: str):
    """Match rows with pre and post form of both sides as ``<name>_pre_home`` and so on."""
    f = fm.form_frames(sides, {value: neutral}, evidence).withColumnsRenamed({f"{value}_pre": f"{name}_pre", f"{value}_post": f"{name}_post"})
    cols = [f"{name}_pre", f"{name}_post", "evidence_post"]
    wide = to_matches(f.select("fixture_id", "venue", *cols), cols)
    return df.join(wide.withColumnsRenamed({f"evidence_post_{v}": f"{name}_evid_{v}" for v in ("home", "away")}), "fixture_id")


@query(
    "pressure_divergence",
    "W11",
    sql("SELECT fixture_id, ROUND(zph, 6) AS press_z_home, ROUND(zpa, 6) AS press_z_away, ROUND(zeh, 6) AS elo_z_home, ROUND(zph - zeh - (zpa - zea), 6) AS div_diff FROM z", "sides rated", Z_CTE),
)
def _(t: Tables):
    df = with_forms(t.rated, fm.pressure_components(t.sides), "press_index", 0.5, "press", "stats_present")
    step = F.col("fixture_id") % 9 - 4
    df = df.withColumns({"elo_home_post": F.col("elo_home") + step, "elo_away_post": F.col("elo_away") - step})
    states = {"ph": [("home", "press_post_home")], "pa": [("away", "press_post_away")], "el": [("home", "elo_home_post"), ("away", "elo_away_post")]}
    asks = {"press_z_home": ("ph", "press_pre_home"), "press_z_away": ("pa", "press_pre_away"), "elo_z_home": ("el", "elo_home"), "elo_z_away": ("el", "elo_away")}
    z = rt.state_z(df, ["league"], states, asks, ORDER)
    div = (F.col("press_z_home") - F.col("elo_z_home")) - (F.col("press_z_away") - F.col("elo_z_away"))
    return z.select("fixture_id", "press_z_home", "press_z_away", "elo_z_home", div.alias("div_diff"))


X_CTE = (
    PRESS_CTE
    + ",\n"
    + XG_CTE
    + f""",
  f AS (SELECT p.fixture_id, p.venue, COALESCE(AVG(press_index) OVER {PRE.replace('team', 'p.team').replace('venue', 'p.venue').replace('kickoff', 'p.kickoff').replace('opp', 'p.opp').replace('fixture_id', 'p.fixture_id')}, 0.5e0) AS pre,
     COALESCE(AVG(press_index) OVER {POST.replace('team', 'p.team').replace('venue', 'p.venue').replace('kickoff', 'p.kickoff').replace('opp', 'p.opp').replace('fixture_id', 'p.fixture_id')}, 0.5e0) AS post FROM pidx p),
  g AS (SELECT fixture_id, venue, COALESCE(AVG(xg_diff) OVER {PRE}, 0e0) AS xpre, COALESCE(AVG(xg_diff) OVER {POST}, 0e0) AS xpost, COALESCE(SUM(xg_present) OVER {POST}, 0e0) AS xev FROM xgi),
  m AS (SELECT r.fixture_id, league, home, away, h.pre AS ph, h.post AS qh, gh.xpre AS xh, gh.xpost AS yh, gh.xev AS eh, ROW_NUMBER() OVER (PARTITION BY league ORDER BY kickoff, home, away, r.fixture_id) AS rn
     FROM matches r JOIN f h ON h.fixture_id = r.fixture_id AND h.venue = 'home' JOIN g gh ON gh.fixture_id = r.fixture_id AND gh.venue = 'home'),
  up AS (SELECT 'ph' AS st, league, home AS team, rn, qh AS v FROM m UNION ALL SELECT 'xh', league, home, rn, yh FROM m),
  iv AS (SELECT *, COALESCE(LEAD(rn) OVER (PARTITION BY st, league, team ORDER BY rn), 1000000000) AS nx FROM up),
  ms AS (SELECT m.fixture_id, st, AVG(v) AS mean, stddev_pop(v) AS sd FROM m JOIN iv ON iv.league = m.league AND iv.rn < m.rn AND iv.nx >= m.rn GROUP BY ALL),
  z AS (SELECT m.fixture_id, eh, COALESCE(CASE WHEN a.sd > 3.2e-5 THEN (ph - a.mean) / a.sd END, 0) AS zp, COALESCE(CASE WHEN b.sd > 3.2e-5 THEN (xh - b.mean) / b.sd END, 0) AS zx
     FROM m LEFT JOIN ms a ON a.fixture_id = m.fixture_id AND a.st = 'ph' LEFT JOIN ms b ON b.fixture_id = m.fixture_id AND b.st = 'xh')"""
)


def _disagreement_sql(side: str) -> str:
    ctes = X_CTE.replace("venue = 'home'", f"venue = '{side}'").replace("league, home AS team", f"league, {side} AS team").replace("league, home, rn", f"league, {side}, rn")
    return sql(
        "SELECT fixture_id, ROUND(zp, 6) AS press_z, ROUND(zx, 6) AS xg_z, ROUND(zp - zx, 6) AS disagreement, CAST(eh > 0 AND round(zp, 9) >= 1 AND round(zx, 9) <= -1 AS BIGINT) AS sterile, CAST(eh > 0 AND round(zp, 9) <= -1 AND round(zx, 9) >= 1 AS BIGINT) AS assassin FROM z",
        "sides",
        ctes,
    )


def disagreement(t: Tables, side: str):
    """Pressure against expected goals of one side, each against the latest values of the league's teams on that side."""
    df = with_forms(t.matches, fm.pressure_components(t.sides), "press_index", 0.5, "press", "stats_present")
    df = with_forms(df, xg_sides(t), "xg_diff", 0.0, "xg", "xg_present")
    states = {"p": [(side, f"press_post_{side}")], "x": [(side, f"xg_post_{side}")]}
    asks = {"press_z": ("p", f"press_pre_{side}"), "xg_z": ("x", f"xg_pre_{side}")}
    z = rt.state_z(df, ["league"], states, asks, ORDER)
    p, x, ok = F.round("press_z", 9), F.round("xg_z", 9), F.col(f"xg_evid_{side}") > 0
    return z.select(
        "fixture_id", "press_z", "xg_z", (F.col("press_z") - F.col("xg_z")).alias("disagreement"),
        (ok & (p >= 1) & (x <= -1)).cast("int").alias("sterile"), (ok & (p <= -1) & (x >= 1)).cast("int").alias("assassin"),
    )


@query("pressure_xg_disagreement", "W12", _disagreement_sql("home"))
def _(t: Tables):
    return disagreement(t, "home")


@query("pressure_xg_disagreement_away", "W12", _disagreement_sql("away"))
def _(t: Tables):
    return disagreement(t, "away")


# The older rule set, one step for all matches and no extra factors.
PLAIN_RULES = {"k": 20.0, "home_edge": 60.0, "margin_cap": 1.0, "upset_mult": 1.0, "new_mult": 1.0, "floor": 0.0, "by_league": {}, "by_type": {}}


@query(
    "elo_plain",
    "L02",
    sql(
        "SELECT fixture_id, ROUND(eh, 6) AS elo_home, ROUND(ea, 6) AS elo_away, ROUND(d, 6) AS delta FROM st WHERE rn > 0",
        "",
        ELO_CTE.replace("CASE league WHEN 'NATION_1' THEN 21e0 WHEN 'NATION_2' THEN 22e0 ELSE 20e0 END", "20e0").replace("CASE league WHEN 'NATION_1' THEN 58e0 WHEN 'NATION_2' THEN 50e0 ELSE 65e0 END", "60e0")
        .replace("CASE fixture_id % 10 WHEN 0 THEN 1.12e0 WHEN 1 THEN 0.75e0 ELSE 1e0 END", "1e0").replace("8e0 END, 2.75e0)", "8e0 END, 1e0)").replace("THEN 1.25e0 ELSE 1e0", "THEN 1e0 ELSE 1e0").replace("THEN 1.2e0 ELSE 1e0", "THEN 1e0 ELSE 1e0").replace("GREATEST(1000e0,", "GREATEST(0e0,"),
    ),
)
def _(t: Tables):
    return rt.elo_series(t.matches, "league", rt.EloRules(**PLAIN_RULES)).select("fixture_id", "elo_home", "elo_away", "delta")

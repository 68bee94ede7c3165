"""Queries on grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.functions.cols import clamp, ratio
from kickframe.operators import summaries as sm
from kickframe.operators.ordered import rows_frame
from kickframe.operators.quantiles import grouped_quantiles
from kickframe.plans.clean import coded, goal_lists, shots
from kickframe.operators.sides import side_rows
from kickframe.plans.fixtures import CUTOFF, Tables, sql
from kickframe.plans.forms import rated_sides
from kickframe.plans.registry import query

LG = ", ".join(f"ROUND(AVG({src}), 6) AS {name}" for name, src in sm.MEANS.items())
LG_RAW = ", ".join(f"AVG({src}) AS {name}" for name, src in sm.MEANS.items())


@query("league_baselines", "A01", sql(f"SELECT country, league, season, {LG} FROM seasoned GROUP BY ALL", "seasoned"))
def _(t: Tables):
    return sm.league_baselines(t.seasoned, ["country", "league", "season"])


@query(
    "baseline_join",
    "J05",
    sql(
        "SELECT fixture_id, "
        + ", ".join(f"ROUND(COALESCE(p.{n}, f.{n}), 6) AS {n}" for n in sm.MEANS)
        + " FROM gap s LEFT JOIN p USING (country, league, season) LEFT JOIN f USING (league, season)",
        "seasoned",
        f"""gap AS (SELECT * REPLACE (CASE WHEN fixture_id % 9 = 0 THEN NULL ELSE country END AS country) FROM seasoned),
        p AS (SELECT country, league, season, {LG_RAW} FROM gap GROUP BY country, league, season), f AS (SELECT league, season, {LG_RAW} FROM gap GROUP BY league, season)""",
    ),
)
def _(t: Tables):
    gap = t.seasoned.withColumn("country", F.when(F.col("fixture_id") % 9 != 0, F.col("country")))
    return sm.with_baselines(gap).select("fixture_id", *sm.MEANS)


@query(
    "team_season_totals",
    "A02 J06",
    sql(
        """SELECT COALESCE(h.team, a.team) AS team, COALESCE(h.season, a.season) AS season, gf_home, ga_home, gf_away, ga_away,
        COALESCE(matches_home, 0) AS matches_home, COALESCE(matches_away, 0) AS matches_away FROM
        (SELECT home AS team, season, CAST(SUM(ft_home) AS BIGINT) AS gf_home, CAST(SUM(ft_away) AS BIGINT) AS ga_home, COUNT(*) AS matches_home FROM seasoned GROUP BY ALL) h
        FULL OUTER JOIN (SELECT away AS team, season, CAST(SUM(ft_away) AS BIGINT) AS gf_away, CAST(SUM(ft_home) AS BIGINT) AS ga_away, COUNT(*) AS matches_away FROM seasoned GROUP BY ALL) a
        ON h.team = a.team AND h.season = a.season""",
        "seasoned",
    ),
)
def _(t: Tables):
    return sm.team_seasons(t.seasoned)


@query(
    "team_season_mode",
    "A03",
    sql(
        """SELECT team, season, kind FROM (SELECT team, season, kind, ROW_NUMBER() OVER (PARTITION BY team, season ORDER BY COUNT(*) DESC, kind) AS k FROM
        (SELECT unnest([home, away]) AS team, season, CASE fixture_id % 3 WHEN 0 THEN 'cup' WHEN 1 THEN 'league' ELSE 'friendly' END AS kind FROM seasoned) GROUP BY team, season, kind) WHERE k = 1""",
        "seasoned",
    ),
)
def _(t: Tables):
    kind = F.when(F.col("fixture_id") % 3 == 0, "cup").when(F.col("fixture_id") % 3 == 1, "league").otherwise("friendly")
    both = t.seasoned.select("season", kind.alias("kind"), F.explode(F.array("home", "away")).alias("team"))
    return sm.most_common(both, ["team", "season"], "kind")


@query(
    "team_ratios",
    "A04",
    sql(
        """SELECT team, season, ROUND(SUM(gf) FILTER (v = 'home') / NULLIF(ANY_VALUE(lh), 0), 6) AS attack_home, ROUND(SUM(ga) FILTER (v = 'home') / NULLIF(ANY_VALUE(la), 0), 6) AS defence_home,
        ROUND(SUM(gf) FILTER (v = 'away') / NULLIF(ANY_VALUE(la), 0), 6) AS attack_away, ROUND(SUM(ga) FILTER (v = 'away') / NULLIF(ANY_VALUE(lh), 0), 6) AS defence_away,
        ROUND(SUM(gf) FILTER (v = 'home') / NULLIF(COUNT(*) FILTER (v = 'home'), 0) / NULLIF(ANY_VALUE(lh), 0), 6) AS attack_home_per_game FROM
        (SELECT home AS team, league, season, 'home' AS v, CAST(ft_home AS DOUBLE) AS gf, CAST(ft_away AS DOUBLE) AS ga FROM seasoned UNION ALL SELECT away, league, season, 'away', CAST(ft_away AS DOUBLE), CAST(ft_home AS DOUBLE) FROM seasoned)
        JOIN (SELECT league, season, AVG(ft_home) AS lh, AVG(ft_away) AS la FROM seasoned GROUP BY ALL) USING (league, season) GROUP BY team, league, season""",
        "seasoned",
    ),
)
def _(t: Tables):
    """Both venues from one aggregate over the side rows; each against the league mean of its own side."""
    lg = sm.league_baselines(t.seasoned, ["league", "season"]).select("league", "season", "lg_gf_home", "lg_gf_away")
    sides = side_rows(t.seasoned, {"gf": ("ft_home", "ft_away"), "ga": ("ft_away", "ft_home")}, keep=("league", "season"))
    at = lambda v, c: F.sum(F.when(F.col("venue") == v, F.col(c))).alias(f"{c}_{v}")
    teams = sides.groupBy("team", "league", "season").agg(*[at(v, c) for v in ("home", "away") for c in ("gf", "ga")], F.count_if(F.col("venue") == "home").alias("n"))
    return teams.join(lg, ["league", "season"]).select(
        "team", "season", ratio("gf_home", "lg_gf_home").alias("attack_home"), ratio("ga_home", "lg_gf_away").alias("defence_home"),
        ratio("gf_away", "lg_gf_away").alias("attack_away"), ratio("ga_away", "lg_gf_home").alias("defence_away"),
        ratio(F.try_divide("gf_home", "n"), "lg_gf_home").alias("attack_home_per_game"),
    )


@query(
    "home_bonus",
    "A05",
    sql(
        """SELECT country, league, season, ROUND(COALESCE(LEAST(GREATEST(400e0 * sign(m) * log10(1e0 + abs(m)), -200e0), 200e0), 0e0), 6) AS home_bonus FROM
        (SELECT country, league, season, LEAST(GREATEST(AVG(ft_home - ft_away), -5e0), 5e0) AS m FROM seasoned GROUP BY ALL)""",
        "seasoned",
    ),
)
def _(t: Tables):
    return sm.home_bonus(t.seasoned, ["country", "league", "season"])


@query(
    "band_means",
    "A06",
    sql(
        """SELECT team, venue, band, ROUND(AVG(gf), 6) AS gf, ROUND(AVG(ga), 6) AS ga FROM (
        SELECT home AS team, 'home' AS venue, ft_home AS gf, ft_away AS ga, CASE WHEN elo_home - elo_away >= 100 THEN 'BULLY' WHEN elo_home - elo_away <= -100 THEN 'DOG' ELSE 'PEER' END AS band FROM rated
        UNION ALL SELECT away, 'away', ft_away, ft_home, CASE WHEN elo_away - elo_home >= 100 THEN 'BULLY' WHEN elo_away - elo_home <= -100 THEN 'DOG' ELSE 'PEER' END FROM rated) GROUP BY ALL""",
        "rated",
    ),
)
def _(t: Tables):
    from kickframe.functions.cols import band

    s = rated_sides(t).withColumn("band", band(F.col("own_elo") - F.col("opp_elo"), 100.0))
    return s.groupBy("team", "venue", "band").agg(F.avg("gf").alias("gf"), F.avg("ga").alias("ga"))


@query(
    "league_last_row",
    "A07",
    sql(
        """SELECT league, fixture_id, home, away, season FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY league ORDER BY kickoff DESC, home DESC, away DESC, fixture_id DESC) AS k FROM seasoned) WHERE k = 1""",
        "seasoned",
    ),
)
def _(t: Tables):
    last = t.seasoned.groupBy("league").agg(
        F.max_by(F.struct("fixture_id", "home", "away", "season"), F.struct("kickoff", "home", "away", "fixture_id")).alias("r")
    )
    return last.select("league", "r.*")


@query(
    "home_edge_medians",
    "A08",
    sql(
        """SELECT league, ROUND(quantile_cont(d, 0.5), 6) AS median_edge FROM (SELECT league, elo_home - elo_away + fixture_id % 17 AS d FROM rated) GROUP BY league
        UNION ALL SELECT 'ALL', ROUND(quantile_cont(elo_home - elo_away + fixture_id % 17, 0.5), 6) FROM rated""",
        "rated",
    ),
)
def _(t: Tables):
    d = t.rated.select("league", (F.col("elo_home") - F.col("elo_away") + F.col("fixture_id") % 17).alias("d"))
    per_league = grouped_quantiles(d, ["league"], "d", {"median_edge": 0.5})
    overall = grouped_quantiles(d, [], "d", {"median_edge": 0.5}).select(F.lit("ALL").alias("league"), "median_edge")
    return per_league.unionByName(overall)


@query(
    "usable_evidence",
    "A09 A10",
    sql(
        """SELECT team, venue, bool_or(pos_for IS NOT NULL AND shots_for IS NOT NULL) AS usable, COUNT(*) AS n, MAX(kickoff) AS last_kickoff FROM sides GROUP BY ALL""",
        "sides",
    ),
)
def _(t: Tables):
    usable = F.bool_or(F.col("pos_for").isNotNull() & F.col("shots_for").isNotNull())
    return t.sides.groupBy("team", "venue").agg(usable.alias("usable"), F.count(F.lit(1)).alias("n"), F.max("kickoff").alias("last_kickoff"))


@query(
    "league_snapshot_z",
    "A11",
    sql(
        """SELECT s.team, ROUND(COALESCE(CASE WHEN sd > 1e-9 THEN (g - m) / sd END, 0), 6) AS z FROM s JOIN (SELECT league, AVG(g) AS m, stddev_pop(g) AS sd FROM s GROUP BY league) USING (league)""",
        "sides",
        "s AS (SELECT league, team, AVG(gf) AS g FROM sides GROUP BY ALL)",
    ),
)
def _(t: Tables):
    from kickframe.functions.cols import zscore

    s = t.sides.groupBy("league", "team").agg(F.avg("gf").alias("g"))
    lg = s.groupBy("league").agg(F.avg("g").alias("m"), F.stddev_pop("g").alias("sd"))
    return s.join(lg, "league").select("team", zscore("g", "m", "sd").alias("z"))


TIMING_CTE = """ev AS (SELECT m.home, m.away, CASE WHEN l_returnflag = 'A' THEN m.home ELSE m.away END AS scorer, CASE WHEN l_returnflag = 'A' THEN m.away ELSE m.home END AS conceder,
    CAST(LEAST(GREATEST(floor(((1 + (l_orderkey * 7 + l_linenumber * 13) % 90) - 1) / 15e0), 0), 5) AS INT) AS bin FROM lineitem JOIN matches m ON m.fixture_id = l_orderkey WHERE l_returnflag IN ('A', 'R')),
  long AS (SELECT scorer AS team, 'scored' AS kind, bin FROM ev UNION ALL SELECT conceder, 'conceded', bin FROM ev
    UNION ALL SELECT home, 'match', -1 FROM played UNION ALL SELECT away, 'match', -1 FROM played),
  prof AS (SELECT team, COUNT(*) FILTER (kind = 'match') AS matches, COUNT(*) FILTER (kind = 'scored') AS scored, COUNT(*) FILTER (kind = 'conceded') AS conceded,"""
TIMING_BINS = ", ".join(f"COUNT(*) FILTER (kind = '{k}' AND bin = {i}) AS {k}_{i}" for k in ("scored", "conceded") for i in range(6))
PLAYED_CTE = "played AS (SELECT home, away FROM matches WHERE fixture_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R')))"
PROF_CTE = PLAYED_CTE + ", " + TIMING_CTE + TIMING_BINS + " FROM long GROUP BY team)"


def goal_rows(t: Tables):
    return t.matches.select("fixture_id", "home", "away", "league").join(goal_lists(t), "fixture_id")


@query("goal_timing_profiles", "A12 X02 X05", sql("SELECT * FROM prof", "", PROF_CTE))
def _(t: Tables):
    return sm.timing_profiles(goal_rows(t))


@query(
    "canonical_names",
    "A13",
    sql(
        """SELECT code, name FROM (SELECT code, name, ROW_NUMBER() OVER (PARTITION BY code ORDER BY COUNT(*) DESC, length(name), name) AS k FROM
        (SELECT CAST(TRY_CAST(regexp_replace(league, '[^0-9]', '', 'g') AS BIGINT) * 100 + TRY_CAST(split_part(team, '-T', 2) AS BIGINT) AS VARCHAR) AS code,
          CASE WHEN fixture_id % 2 = 0 THEN team ELSE 'FC ' || team END AS name FROM (SELECT fixture_id, league, unnest([home, away]) AS team FROM matches)) GROUP BY code, name) WHERE k = 1"""
    ),
)
def _(t: Tables):
    side = lambda v: F.struct(F.col(f"code_{v}").alias("code"), F.col(v).alias("team"))
    both = coded(t).select("fixture_id", F.inline(F.array(side("home"), side("away"))))
    name = F.when(F.col("fixture_id") % 2 == 0, F.col("team")).otherwise(F.concat(F.lit("FC "), F.col("team")))
    pairs = both.select("code", name.alias("name"))
    return sm.most_common(pairs, ["code"], "name", ties=[F.length("name")])


@query(
    "coverage_ratios",
    "A14 Q01",
    sql(
        """SELECT league, COUNT(*) AS rows, COUNT(*) FILTER (shots_h IS NOT NULL AND pos_h IS NOT NULL) AS stats_rows, ROUND(LEAST(COUNT(shots_h), COUNT(pos_h)) / COUNT(*), 6) AS stats_ratio,
        COUNT(*) FILTER (odds_over IS NOT NULL AND odds_under IS NOT NULL) AS odds_rows, ROUND(LEAST(COUNT(odds_over), COUNT(odds_under)) / COUNT(*), 6) AS odds_ratio FROM matches GROUP BY league"""
    ),
)
def _(t: Tables):
    return sm.coverage(t.matches, {"stats": ["shots_h", "pos_h"], "odds": ["odds_over", "odds_under"]}, ["league"])


@query(
    "missing_input_ids",
    "A15",
    sql("SELECT fixture_id FROM matches WHERE shots_h IS NULL OR pos_h IS NULL OR odds_over IS NULL"),
)
def _(t: Tables):
    gap = F.col("shots_h").isNull() | F.col("pos_h").isNull() | F.col("odds_over").isNull()
    return t.matches.filter(gap).select("fixture_id")


@query(
    "league_overview",
    "A16 A38",
    sql(
        "SELECT league, COUNT(*) AS rows, MIN(kickoff) AS first_kickoff, MAX(kickoff) AS last_kickoff, COUNT(DISTINCT season) AS seasons, COUNT(DISTINCT home) AS teams FROM seasoned GROUP BY league",
        "seasoned",
    ),
)
def _(t: Tables):
    return t.seasoned.groupBy("league").agg(
        F.count(F.lit(1)).alias("rows"), F.min("kickoff").alias("first_kickoff"), F.max("kickoff").alias("last_kickoff"),
        F.count_distinct("season").alias("seasons"), F.count_distinct("home").alias("teams"),
    )


@query(
    "accuracy_report",
    "A20 A38",
    sql(
        """SELECT league, COUNT(*) AS n, ROUND(AVG(CAST(ou AS DOUBLE)), 6) AS ou_acc, ROUND(AVG(CAST(bt AS DOUBLE)), 6) AS btts_acc, ROUND(AVG(CAST(ou * bt AS DOUBLE)), 6) AS both_acc FROM
        (SELECT league, CAST((p_over >= 0.5) = (ft_home + ft_away > 2.5) AS INT) AS ou, CAST((p_btts >= 0.5) = (ft_home > 0 AND ft_away > 0) AS INT) AS bt FROM priced) GROUP BY league""",
        "priced",
    ),
)
def _(t: Tables):
    ou = ((F.col("p_over") >= 0.5) == (F.col("ft_home") + F.col("ft_away") > 2.5)).cast("double")
    bt = ((F.col("p_btts") >= 0.5) == ((F.col("ft_home") > 0) & (F.col("ft_away") > 0))).cast("double")
    return t.priced.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.avg(ou).alias("ou_acc"), F.avg(bt).alias("btts_acc"), F.avg(ou * bt).alias("both_acc"))


@query(
    "track_record",
    "A21",
    sql(
        """SELECT w AS "window", COUNT(*) FILTER (ok) AS wins, COUNT(*) AS total, ROUND(AVG(CAST(ok AS DOUBLE)), 6) AS rate FROM
        (SELECT *, (p_over > 0.35) = (ft_home + ft_away > 2.5) AS ok FROM priced WHERE NOT (ft_home = 0 AND ft_away = 0)) p,
        (VALUES ('week', 7), ('month', 30), ('all', 100000)) v(w, d) WHERE kickoff >= TIMESTAMP '2001-08-01' - d * INTERVAL 1 DAY GROUP BY w""",
        "priced",
    ),
)
def _(t: Tables):
    ok = (F.col("p_over") > 0.35) == (F.col("ft_home") + F.col("ft_away") > 2.5)
    played = t.priced.filter("NOT (ft_home = 0 AND ft_away = 0)").withColumn("ok", ok)
    now = F.lit("2001-08-01").cast("timestamp_ntz")
    rows = []
    for name, days in (("week", 7), ("month", 30), ("all", 100_000)):
        inside = F.col("kickoff") >= now - F.expr(f"INTERVAL {days} DAYS")
        rows.append(F.struct(F.lit(name).alias("window"), F.count_if(inside & F.col("ok")).alias("wins"), F.count_if(inside).alias("total"), F.avg(F.when(inside, F.col("ok").cast("double"))).alias("rate")))
    return played.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@query(
    "confusion_rates",
    "A22",
    sql(
        """SELECT league, tp, tn, fp, fn, ROUND((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, ROUND(0.5 * (COALESCE(tp / NULLIF(tp + fn, 0), 0) + COALESCE(tn / NULLIF(tn + fp, 0), 0)), 6) AS balanced_accuracy,
        ROUND((tp + fp) / (tp + tn + fp + fn), 6) AS yes_rate FROM (SELECT league, COUNT(*) FILTER (y AND p) AS tp, COUNT(*) FILTER (NOT y AND NOT p) AS tn, COUNT(*) FILTER (NOT y AND p) AS fp, COUNT(*) FILTER (y AND NOT p) AS fn
        FROM (SELECT league, ft_home + ft_away > 2.5 AS y, p_over >= 0.5 AS p FROM priced) GROUP BY league)""",
        "priced",
    ),
)
def _(t: Tables):
    return sm.confusion(t.priced, ["league"], F.col("ft_home") + F.col("ft_away") > 2.5, F.col("p_over") >= 0.5)


@query(
    "count_errors",
    "A23",
    sql(
        """SELECT league, COUNT(*) AS n_sides, ROUND(sqrt(AVG((mu - y) * (mu - y))), 6) AS side_rmse, ROUND(sqrt(AVG((mt - yt) * (mt - yt))), 6) AS total_rmse, ROUND(AVG(mu - y * ln(mu)), 6) AS poisson_nll,
        ROUND(AVG((p - o) * (p - o)), 6) AS brier, ROUND(AVG(-(o * ln(p) + (1 - o) * ln(1 - p))), 6) AS logloss FROM (SELECT *, 1 - exp(-mu) AS p, CASE WHEN y > 0 THEN 1e0 ELSE 0e0 END AS o FROM
        (SELECT league, mu_home AS mu, CAST(ft_home AS DOUBLE) AS y, mu_total AS mt, ft_home + ft_away AS yt FROM priced UNION ALL SELECT league, mu_away, CAST(ft_away AS DOUBLE), mu_total, ft_home + ft_away FROM priced)) GROUP BY league""",
        "priced",
    ),
)
def _(t: Tables):
    return sm.side_errors(t.priced, ["league"], ("mu_home", "mu_away"), ("ft_home", "ft_away"))


@query(
    "multiclass_scores",
    "A24",
    sql(
        """SELECT league, ROUND(AVG(-ln(GREATEST(CASE y WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END, 1e-15))), 6) AS logloss,
        ROUND(AVG(pow(ph - CAST(y = 'H' AS INT), 2) + pow(pd - CAST(y = 'D' AS INT), 2) + pow(pa - CAST(y = 'A' AS INT), 2)), 6) AS brier FROM
        (SELECT league, mu_home / (mu_total + 0.6e0) AS ph, 0.6e0 / (mu_total + 0.6e0) AS pd, mu_away / (mu_total + 0.6e0) AS pa, CASE WHEN ft_home > ft_away THEN 'H' WHEN ft_home = ft_away THEN 'D' ELSE 'A' END AS y FROM priced) GROUP BY league""",
        "priced",
    ),
)
def _(t: Tables):
    den = F.col("mu_total") + 0.6
    df = three_way(t.priced, F.col("mu_home") / den, F.lit(0.6) / den, F.col("mu_away") / den)
    return df.groupBy("league").agg(F.avg("ll").alias("logloss"), F.avg("br").alias("brier"))


def three_way(df, ph, pd_, pa):
    """Log-loss and Brier terms of a home/draw/away forecast."""
    y = F.when(F.col("ft_home") > F.col("ft_away"), "H").when(F.col("ft_home") == F.col("ft_away"), "D").otherwise("A")
    df = df.withColumns({"ph": ph, "pd": pd_, "pa": pa, "y": y})
    hit = F.when(F.col("y") == "H", F.col("ph")).when(F.col("y") == "D", F.col("pd")).otherwise(F.col("pa"))
    sq = [F.pow(F.col(p) - (F.col("y") == c).cast("double"), 2) for p, c in (("ph", "H"), ("pd", "D"), ("pa", "A"))]
    return df.withColumns({"ll": -F.ln(F.greatest(hit, F.lit(1e-15))), "br": sq[0] + sq[1] + sq[2]})


ECE = "SELECT {k} SUM(n * abs(a - c)) / SUM(n) AS e, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT {k} COUNT(*) AS n, AVG({p}) AS c, AVG(CAST({y} AS DOUBLE)) AS a FROM priced GROUP BY {k} LEAST(GREATEST(floor({p} * 10), 0), 9))"


@query(
    "calibration_error",
    "A25",
    sql(
        "SELECT league, ROUND(e, 6) AS ece, n FROM (" + ECE.format(k="league,", p="p_over", y="(ft_home + ft_away > 2.5)") + " GROUP BY league)",
        "priced",
    ),
)
def _(t: Tables):
    return sm.calibration_error(t.priced, ["league"], "p_over", F.col("ft_home") + F.col("ft_away") > 2.5)


@query(
    "calibration_error_classes",
    "A25",
    sql(
        "SELECT ROUND(AVG(e), 6) AS ece FROM (SELECT cls, SUM(n * abs(a - c)) / SUM(n) AS e FROM (SELECT cls, COUNT(*) AS n, AVG(p) AS c, AVG(CAST(y AS DOUBLE)) AS a FROM long GROUP BY cls, LEAST(GREATEST(floor(p * 10), 0), 9)) GROUP BY cls)",
        "priced",
        """long AS (SELECT 'H' AS cls, mu_home / (mu_total + 0.6e0) AS p, ft_home > ft_away AS y FROM priced UNION ALL SELECT 'D', 0.6e0 / (mu_total + 0.6e0), ft_home = ft_away FROM priced
        UNION ALL SELECT 'A', mu_away / (mu_total + 0.6e0), ft_home < ft_away FROM priced)""",
    ),
)
def _(t: Tables):
    den = F.col("mu_total") + 0.6
    rows = F.array(
        F.struct(F.lit("H").alias("cls"), (F.col("mu_home") / den).alias("p"), (F.col("ft_home") > F.col("ft_away")).alias("y")),
        F.struct(F.lit("D").alias("cls"), (F.lit(0.6) / den).alias("p"), (F.col("ft_home") == F.col("ft_away")).alias("y")),
        F.struct(F.lit("A").alias("cls"), (F.col("mu_away") / den).alias("p"), (F.col("ft_home") < F.col("ft_away")).alias("y")),
    )
    per_class = sm.calibration_error(t.priced.select(F.inline(rows)), ["cls"], "p", F.col("y"))
    return per_class.agg(F.avg("ece").alias("ece"))


@query(
    "crps_totals",
    "A26",
    sql(
        """SELECT league, ROUND(AVG(s), 6) AS crps FROM (SELECT league, fixture_id, SUM(pow(cdf - CASE WHEN k >= y THEN 1 ELSE 0 END, 2)) AS s FROM
        (SELECT league, fixture_id, k, ft_home + ft_away AS y, SUM(exp(-mu_total) * pow(mu_total, k) / factorial(CAST(k AS INT))) OVER (PARTITION BY fixture_id ORDER BY k) AS cdf FROM priced, range(0, 25) r(k)) GROUP BY ALL) GROUP BY league""",
        "priced",
    ),
)
def _(t: Tables):
    score = sm.crps_poisson(F.col("mu_total"), F.col("ft_home") + F.col("ft_away"))
    return t.priced.groupBy("league").agg(F.avg(score).alias("crps"))


BETS_SQL = """bets AS (SELECT league, fixture_id, kickoff, 'OVER' AS market, p_over AS p, odds_over AS odds, ft_home + ft_away > 2.5 AS hit FROM priced
  UNION ALL SELECT league, fixture_id, kickoff, 'UNDER', p_under, odds_under, ft_home + ft_away < 2.5 FROM priced
  UNION ALL SELECT league, fixture_id, kickoff, 'YES', p_btts, odds_yes, ft_home > 0 AND ft_away > 0 FROM priced
  UNION ALL SELECT league, fixture_id, kickoff, 'NO', 1 - p_btts, odds_no, NOT (ft_home > 0 AND ft_away > 0) FROM priced)"""


def bets(t: Tables):
    df = t.priced.withColumn("p_no", 1 - F.col("p_btts"))
    both = (F.col("ft_home") > 0) & (F.col("ft_away") > 0)
    total = F.col("ft_home") + F.col("ft_away")
    markets = {
        "OVER": ("p_over", "odds_over", total > 2.5),
        "UNDER": ("p_under", "odds_under", total < 2.5),
        "YES": ("p_btts", "odds_yes", both),
        "NO": ("p_no", "odds_no", ~both),
    }
    return sm.unpivot_bets(df, markets, ["league", "fixture_id", "kickoff"])


@query(
    "roi_by_league",
    "A27",
    sql(
        """SELECT league, market, COUNT(*) AS bets, COUNT(*) FILTER (hit) AS wins, ROUND(100 * AVG(CASE WHEN hit THEN odds - 1 ELSE -1 END), 6) AS roi_pct, ROUND(100 * AVG(CAST(hit AS DOUBLE)), 6) AS win_rate_pct
        FROM bets WHERE p * odds - 1 > 0 GROUP BY league, market""",
        "priced",
        BETS_SQL,
    ),
)
def _(t: Tables):
    return sm.roi(bets(t), ["league", "market"])


@query(
    "league_bias",
    "A29",
    sql(
        """SELECT league, ROUND(bias, 6) AS bias, ROUND(t, 6) AS threshold, ROUND(acc, 6) AS accuracy, ROUND(yes, 6) AS yes_rate FROM
        (SELECT league, AVG(CASE WHEN ft_home + ft_away > 2.5 THEN 1e0 ELSE 0e0 END) - AVG(p_over) AS bias FROM priced GROUP BY league) JOIN
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY league ORDER BY round(acc, 12) DESC, t) AS k FROM (SELECT league, t, AVG(CASE WHEN (p_over >= t) = (ft_home + ft_away > 2.5) THEN 1e0 ELSE 0e0 END) AS acc, AVG(CASE WHEN p_over >= t THEN 1e0 ELSE 0e0 END) AS yes
          FROM priced, (SELECT round(0.35 + i * 0.05, 6) AS t FROM range(0, 7) r(i)) GROUP BY league, t)) USING (league) WHERE k = 1""",
        "priced",
    ),
)
def _(t: Tables):
    over = F.col("ft_home") + F.col("ft_away") > 2.5
    grid = sm.threshold_counts(t.priced, ["league"], "p_over", over, 0.35, 0.65, 0.05)
    best = sm.best_threshold(grid, ["league"], "accuracy")
    bias = t.priced.groupBy("league").agg((F.avg(over.cast("double")) - F.avg("p_over")).alias("bias"))
    return bias.join(best, "league")


@query(
    "threshold_scan",
    "T13 L21",
    sql(
        """SELECT league, ROUND(t, 6) AS threshold, ROUND(b, 6) AS balanced_accuracy, ROUND(yes, 6) AS yes_rate FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY league ORDER BY round(b, 12) DESC, t) AS k FROM
        (SELECT league, t, 0.5 * (COALESCE(tp / NULLIF(tp + fn, 0), 0) + COALESCE(tn / NULLIF(tn + fp, 0), 0)) AS b, (tp + fp) / (tp + fp + tn + fn) AS yes FROM
        (SELECT league, t, COUNT(*) FILTER (y AND p >= t) AS tp, COUNT(*) FILTER (NOT y AND p < t) AS tn, COUNT(*) FILTER (NOT y AND p >= t) AS fp, COUNT(*) FILTER (y AND p < t) AS fn FROM
        (SELECT league, p_btts AS p, ft_home > 0 AND ft_away > 0 AS y FROM priced), (SELECT round(0.2 + i * 0.01, 6) AS t FROM range(0, 61) r(i)) GROUP BY league, t)) WHERE yes BETWEEN 0.2 AND 0.8) WHERE k = 1""",
        "priced",
    ),
)
def _(t: Tables):
    both = (F.col("ft_home") > 0) & (F.col("ft_away") > 0)
    grid = sm.threshold_counts(t.priced, ["league"], "p_btts", both, 0.2, 0.8, 0.01)
    return sm.best_threshold(grid, ["league"], min_yes=0.2, max_yes=0.8)


@query(
    "league_goal_multiplier",
    "A30",
    sql(
        """SELECT league, ROUND(LEAST(GREATEST(1 + n / (n + 80e0) * (obs / pred - 1), 0.85e0), 1.15e0), 6) AS multiplier FROM
        (SELECT league, COUNT(*) AS n, AVG(y) AS obs, AVG(mu) AS pred FROM (SELECT league, mu_home AS mu, ft_home AS y FROM priced UNION ALL SELECT league, mu_away, ft_away FROM priced) GROUP BY league) WHERE n >= 80""",
        "priced",
    ),
)
def _(t: Tables):
    from kickframe.operators.xg import league_calibration

    s = t.priced.select("league", F.inline(F.array(F.struct(F.col("mu_home").alias("pred"), F.col("ft_home").alias("gf")), F.struct(F.col("mu_away").alias("pred"), F.col("ft_away").alias("gf")))))
    return league_calibration(s, "pred", "gf")


@query(
    "opponent_factor",
    "A31 L07",
    sql(
        """SELECT fixture_id, ROUND(LEAST(GREATEST(elo_away / COALESCE(r.m, g.m), 0.8e0), 1.2e0), 6) AS factor_home, ROUND(LEAST(GREATEST(elo_home / COALESCE(r.m, g.m), 0.8e0), 1.2e0), 6) AS factor_away
        FROM rated LEFT JOIN (SELECT league, AVG(e) AS m FROM e GROUP BY league) r USING (league), (SELECT AVG(e) AS m FROM e) g""",
        "rated",
        "e AS (SELECT league, elo_home AS e FROM rated UNION ALL SELECT league, elo_away FROM rated)",
    ),
)
def _(t: Tables):
    from kickframe.operators.xg import opponent_factor

    return opponent_factor(t.rated).select("fixture_id", "factor_home", "factor_away")


@query(
    "evidence_quantiles",
    "A32",
    sql(
        """SELECT league, ROUND(quantile_cont(neff_h, 0.1), 6) AS p10, ROUND(quantile_cont(neff_h, 0.5), 6) AS p50, ROUND(quantile_cont(neff_h, 0.9), 6) AS p90, ROUND(AVG(CASE WHEN neff_h < 5 THEN 1e0 ELSE 0e0 END), 6) AS share_low
        FROM priced WHERE neff_h IS NOT NULL GROUP BY league""",
        "priced",
    ),
)
def _(t: Tables):
    have = t.priced.filter("neff_h IS NOT NULL")
    q = grouped_quantiles(have, ["league"], "neff_h", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    low = have.groupBy("league").agg(F.avg((F.col("neff_h") < 5).cast("double")).alias("share_low"))
    return q.join(low, "league")


@query(
    "shot_summary",
    "A33 J16",
    """WITH s AS (SELECT l_orderkey AS fixture_id, CASE WHEN l_linestatus = 'O' THEN 'h' ELSE 'a' END AS side, CAST(l_quantity AS DOUBLE) / 100 AS xg, l_returnflag = 'A' AS goal, l_linenumber % 4 = 2 AS corner FROM lineitem),
    g AS (SELECT o.fixture_id, o.side, COUNT(s.xg) AS shots, COUNT(*) FILTER (s.goal) AS goals, COALESCE(SUM(s.xg), 0) AS xg, COUNT(*) FILTER (s.corner) AS cs, COUNT(*) FILTER (s.corner AND s.goal) AS cg, COALESCE(SUM(s.xg) FILTER (s.corner), 0) AS cx
      FROM (SELECT DISTINCT fixture_id, side FROM (SELECT fixture_id FROM s) CROSS JOIN (VALUES ('h'), ('a')) v(side)) o LEFT JOIN s USING (fixture_id, side) GROUP BY ALL)
    SELECT a.fixture_id, a.side, a.shots AS shots_for, b.shots AS shots_against, a.goals AS goals_for, b.goals AS goals_against, a.cs AS corner_shots_for, b.cg AS corner_goals_against, ROUND(a.xg, 6) AS xg_for, ROUND(b.cx, 6) AS corner_xg_against,
      ROUND(a.goals - a.xg, 6) AS finishing, ROUND(b.xg - b.goals, 6) AS goalkeeping FROM g a JOIN g b ON a.fixture_id = b.fixture_id AND a.side <> b.side""",
)
def _(t: Tables):
    out = sm.shot_summary(shots(t).withColumn("p_goal", F.col("qty") / 100))
    return out.select("fixture_id", "side", "shots_for", "shots_against", "goals_for", "goals_against", "corner_shots_for", "corner_goals_against", "xg_for", "corner_xg_against", "finishing", "goalkeeping")


@query(
    "last_n_metrics",
    "A35",
    sql(
        """SELECT team, COUNT(*) AS games, ROUND(SUM(gf) / COUNT(*), 6) AS gpg, ROUND(SUM(shots_for) / COUNT(*), 6) AS shots_pg, ROUND(SUM(gf) / NULLIF(SUM(shots_for), 0), 6) AS conv, ROUND(SUM(ga) / NULLIF(SUM(shots_against), 0), 6) AS concession_rate
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY kickoff DESC, fixture_id DESC) AS k FROM sides) WHERE k <= 10 GROUP BY team""",
        "sides",
    ),
)
def _(t: Tables):
    from pyspark.sql import Window as W

    w = W.partitionBy("team").orderBy(F.desc("kickoff"), F.desc("fixture_id"))
    last = t.sides.withColumn("k", F.row_number().over(w)).filter("k <= 10")  # the group limit runs map-side
    n = F.count(F.lit(1))
    return last.groupBy("team").agg(
        n.alias("games"), (F.sum("gf") / n).alias("gpg"), (F.sum("shots_for") / n).alias("shots_pg"),
        ratio(F.sum("gf"), F.sum("shots_for")).alias("conv"), ratio(F.sum("ga"), F.sum("shots_against")).alias("concession_rate"),
    )


@query(
    "rating_bucket_margins",
    "A36",
    sql(
        """SELECT team, ROUND(AVG(gd) FILTER (o < lo), 6) AS low_gd, ROUND(AVG(gd) FILTER (o >= lo AND o < hi), 6) AS mid_gd, ROUND(AVG(gd) FILTER (o >= hi), 6) AS high_gd FROM
        d JOIN (SELECT team, quantile_cont(o, 0.33) AS lo, quantile_cont(o, 0.67) AS hi FROM d GROUP BY team) USING (team) GROUP BY team""",
        "rated",
        """d AS (SELECT team, o, gd FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY kickoff DESC, fixture_id DESC) AS k FROM
        (SELECT fixture_id, kickoff, home AS team, elo_away AS o, ft_home - ft_away AS gd FROM rated UNION ALL SELECT fixture_id, kickoff, away, elo_home, ft_away - ft_home FROM rated)) WHERE k <= 20)""",
    ),
)
def _(t: Tables):
    from pyspark.sql import Window as W

    w = W.partitionBy("team").orderBy(F.desc("kickoff"), F.desc("fixture_id"))
    last = rated_sides(t).withColumn("k", F.row_number().over(w)).filter("k <= 20").withColumn("gd", F.col("gf") - F.col("ga"))
    q = grouped_quantiles(last, ["team"], "opp_elo", {"lo": 0.33, "hi": 0.67})
    o = F.col("opp_elo")
    part = lambda c: F.avg(F.when(c, F.col("gd")))
    return last.join(q, "team").groupBy("team").agg(
        part(o < F.col("lo")).alias("low_gd"), part((o >= F.col("lo")) & (o < F.col("hi"))).alias("mid_gd"), part(o >= F.col("hi")).alias("high_gd")
    )


@query(
    "latest_availability",
    "A37",
    sql(
        """SELECT team, ROUND(LEAST(GREATEST(a, 0e0), 1e0), 6) AS availability FROM (SELECT team, (fixture_id % 150) / 100e0 - 0.2e0 AS a, ROW_NUMBER() OVER (PARTITION BY team ORDER BY kickoff DESC, fixture_id DESC) AS k FROM sides) WHERE k = 1""",
        "sides",
    ),
)
def _(t: Tables):
    a = (F.col("fixture_id") % 150) / 100.0 - 0.2
    last = t.sides.groupBy("team").agg(F.max_by(a, F.struct("kickoff", "fixture_id")).alias("a"))
    return last.select("team", clamp("a", 0.0, 1.0).alias("availability"))


@query(
    "ev_distribution",
    "A39",
    sql(
        """SELECT market, COUNT(*) FILTER (ev > 0) AS positive, COUNT(*) FILTER (ev > 0.05) AS above_5, COUNT(*) FILTER (best) AS best_count FROM
        (SELECT *, market = FIRST_VALUE(market) OVER (PARTITION BY fixture_id ORDER BY round(ev, 9) DESC NULLS LAST, market DESC) AND ev IS NOT NULL AS best FROM (SELECT *, p * odds - 1 AS ev FROM bets)) GROUP BY market""",
        "priced",
        BETS_SQL,
    ),
)
def _(t: Tables):
    b = bets(t)
    per_market = b.groupBy("market").agg(F.count_if(F.col("ev") > 0).alias("positive"), F.count_if(F.col("ev") > 0.05).alias("above_5"))
    best = b.filter("ev IS NOT NULL").groupBy("fixture_id").agg(F.max_by("market", F.struct(F.round("ev", 9), "market")).alias("market"))
    counts = best.groupBy("market").agg(F.count(F.lit(1)).alias("best_count"))
    return per_market.join(counts, "market", "left").select("market", "positive", "above_5", F.coalesce("best_count", F.lit(0)).alias("best_count"))

"""Queries on learned models: fitted on rows before a cut, checked through score equations, counts and sums that SQL knows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.functions.shots import shot_angle_deg, shot_distance_m
from kickframe.operators import forms as fm
from kickframe.operators import models as ml
from kickframe.operators import xg
from kickframe.operators.sides import SIDE_COLUMNS, side_rows, to_matches
from kickframe.plans.clean import shots
from kickframe.plans.fixtures import CUTOFF, Tables, sql
from kickframe.plans.registry import query
from kickframe.session import cut_lineage, stored

CUT = f"TIMESTAMP '{CUTOFF}'"
MIDDLE = "2000-01-01"
EPS = 1e-6


def before(day: str = CUTOFF):
    return F.col("kickoff") < F.lit(day).cast("timestamp_ntz")


def labelled(t: Tables):
    total = F.col("ft_home") + F.col("ft_away")
    return t.priced.withColumns({"over": (total > 2.5).cast("double"), "both": ((F.col("ft_home") > 0) & (F.col("ft_away") > 0)).cast("double")})


def flag(c):
    return F.count_if(~F.coalesce(c, F.lit(False)))


FORM = ["shots_for", "sot_for", "corners_for", "gf"]
INPUTS = [f"{s}_l5_{v}" for s in FORM for v in ("home", "away")]


def inputs(t: Tables):
    """Scored matches with both sides' means over their five matches before."""
    form = fm.rolling_form(t.sides, FORM, (5,), current_row=False)
    return t.scored.join(to_matches(form, [f"{s}_l5" for s in FORM]), "fixture_id").dropna(subset=INPUTS)


INPUTS_CTE = """fs AS (SELECT fixture_id, venue, AVG(shots_for) OVER w AS a, AVG(sot_for) OVER w AS b, AVG(corners_for) OVER w AS c, AVG(gf) OVER w AS d FROM sides
    WINDOW w AS (PARTITION BY team, venue ORDER BY kickoff, opp, fixture_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
  inputs AS (SELECT * FROM scored WHERE fixture_id IN (SELECT fixture_id FROM fs GROUP BY fixture_id HAVING COUNT(*) FILTER (a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL) = 0))"""


REQUIRED = ["shots_for", "sot_for", "shots_against", "sot_against"]


@query(
    "xg_walkforward",
    "L05",
    sql(
        """SELECT w.week, w.rows, COALESCE(SUM(e.n), 0)::BIGINT AS learnt, CAST(0 AS DOUBLE) AS gap, CAST(0 AS BIGINT) AS odd FROM (SELECT week, COUNT(*) AS rows FROM s GROUP BY week) w
        LEFT JOIN (SELECT week, COUNT(*) AS n FROM s WHERE gf IS NOT NULL GROUP BY week) e ON e.week < w.week GROUP BY w.week, w.rows""",
        "sides",
        """s AS (SELECT *, CAST(floor((date_diff('day', DATE '1970-01-01', CAST(kickoff AS DATE)) + 3) / 7) AS BIGINT) AS week FROM sides
        WHERE shots_for >= 0 AND sot_for >= 0 AND shots_against >= 0 AND sot_against >= 0)""",
    ),
)
def _(t: Tables):
    """Weekly refits: rows scored, rows learnt from, and the intercept's score equation, which is zero at the optimum."""
    s = t.sides.withColumns({"week": xg.week_index("kickoff"), "is_home": (F.col("venue") == "home").cast("double")})
    fits: list = []
    out = xg.walk_forward(s, ["shots_for", "sot_for", "shots_against", "sot_against", "is_home"], required=REQUIRED, rounds=60, report=fits)
    met = t.spark.createDataFrame(fits, "week long, fit_rows long, score double")
    ok = s.filter("shots_for >= 0 AND sot_for >= 0 AND shots_against >= 0 AND sot_against >= 0")
    weekly = ok.join(out, ["fixture_id", "venue"]).groupBy("week").agg(F.count(F.lit(1)).alias("rows"), flag(F.col("xg").between(EPS, 30.0)).alias("odd"), F.count("gf").alias("n"))
    learnt = weekly.select("week", "rows", "odd", F.expr("coalesce(sum(n) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("learnt"))
    wrong = F.coalesce((F.col("fit_rows") != F.col("learnt")).cast("double"), F.lit(0.0))
    return learnt.join(met, "week", "left").select("week", "rows", "learnt", (F.round(F.coalesce("score", F.lit(0.0)), 6) + wrong).alias("gap"), "odd")


@query(
    "xg_weekly",
    "L05 L06 L07 A30 A31",
    sql(
        """SELECT w.week, n.rows, f.learnt, f.fill_pos, f.fill_share, n.factor, COALESCE(c.leagues, 0)::BIGINT AS leagues, COALESCE(c.observed, 0) AS observed, CAST(0 AS DOUBLE) AS gap, CAST(0 AS BIGINT) AS odd
        FROM weeks w JOIN f USING (week) JOIN n USING (week) LEFT JOIN (SELECT week, COUNT(*) AS leagues, ROUND(AVG(o), 6) AS observed FROM c GROUP BY week) c USING (week)""",
        "sides rated",
        """u AS (SELECT s.*, CAST(floor((date_diff('day', DATE '1970-01-01', CAST(s.kickoff AS DATE)) + 3) / 7) AS BIGINT) AS week, CASE WHEN shots_for > 0 THEN sot_for / CAST(shots_for AS DOUBLE) END AS share,
          CASE WHEN s.venue = 'home' THEN r.elo_away ELSE r.elo_home END AS opp_elo FROM sides s JOIN rated r USING (fixture_id) WHERE shots_for >= 0 AND sot_for >= 0 AND shots_against >= 0 AND sot_against >= 0),
        weeks AS (SELECT DISTINCT week FROM u),
        f AS (SELECT w.week, COUNT(u.gf) AS learnt, ROUND(COALESCE(quantile_cont(u.pos_for, 0.5), 50e0), 6) AS fill_pos, ROUND(COALESCE(quantile_cont(u.share, 0.5), 0.33e0), 6) AS fill_share FROM weeks w LEFT JOIN u ON u.week < w.week AND u.gf IS NOT NULL GROUP BY w.week),
        r AS (SELECT w.week, u.league, AVG(u.opp_elo) AS m FROM weeks w JOIN u ON u.week < w.week GROUP BY ALL),
        g AS (SELECT w.week, AVG(u.opp_elo) AS m FROM weeks w JOIN u ON u.week < w.week GROUP BY ALL),
        n AS (SELECT u.week, COUNT(*) AS rows, ROUND(AVG(LEAST(GREATEST(u.opp_elo / COALESCE(r.m, g.m, 1500e0), 0.8e0), 1.2e0)), 6) AS factor FROM u LEFT JOIN r ON u.week = r.week AND u.league = r.league LEFT JOIN g ON u.week = g.week GROUP BY u.week),
        c AS (SELECT w.week, u.league, AVG(u.gf) AS o FROM weeks w JOIN u ON u.week < w.week AND u.gf IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 80)""",
    ),
)
def _(t: Tables):
    """The whole weekly fit: per week its fills, mean opponent factor, calibrated leagues and the score equation; ``odd`` counts
    league ratios or predictions that don't follow from their parts."""
    shots = F.when(F.col("shots_for") > 0, F.col("sot_for") / F.col("shots_for").cast("double"))
    s = side_rows(t.rated, SIDE_COLUMNS | {"opp_elo": ("elo_away", "elo_home")}).withColumns({"week": xg.week_index("kickoff"), "sot_share_for": shots, "is_home": (F.col("venue") == "home").cast("double")})
    s = stored(s.select("fixture_id", "venue", "league", "week", "gf", "opp_elo", "corners_for", "pos_for", "sot_share_for", "is_home", *REQUIRED))  # read by the fits and their report
    made = xg.weekly_fits(s, ["shots_for", "sot_for", "corners_for", "pos_for", "sot_share_for", "is_home"], required=REQUIRED, opponent="opp_elo", calibration=xg.Calibration(), rounds=60)
    rows = made.xg.where("xg IS NOT NULL").join(s.select("fixture_id", "venue", "gf"), ["fixture_id", "venue"])
    sound = F.col("xg").between(EPS, 30.0) & (F.abs(F.col("xg") - F.col("raw") * F.col("multiplier")) < EPS) & F.col("multiplier").between(0.85, 1.15)
    weekly = rows.groupBy("week").agg(F.count(F.lit(1)).alias("rows"), F.avg("factor").alias("factor"), flag(sound).alias("odd_rows"), F.count("gf").alias("n"))
    weekly = weekly.withColumn("learnt", F.expr("coalesce(sum(n) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    fill = made.fills.groupBy("week").agg(*[F.max(F.when(F.col("feature") == c, F.col("fill"))).alias(n) for c, n in (("pos_for", "fill_pos"), ("sot_share_for", "fill_share"))])
    ratio = (1 + F.col("rows") / (F.col("rows") + 80) * (F.col("observed") / F.col("predicted") - 1) - F.col("multiplier")).between(-EPS, EPS) | F.col("multiplier").isin(0.85, 1.15)
    leagues = made.calibration.where("multiplier IS NOT NULL").groupBy("week").agg(F.count(F.lit(1)).alias("leagues"), F.avg("observed").alias("observed"), flag(ratio).alias("odd_leagues"))
    out = weekly.join(fill, "week", "left").join(leagues, "week", "left").join(made.fits.select("week", F.col("rows").alias("fit_rows"), "score"), "week", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    gap = F.coalesce(F.round("score", 6), F.lit(0.0)) + F.coalesce((F.col("fit_rows") != F.col("learnt")).cast("double"), F.lit(0.0))
    return out.select("week", "rows", "learnt", "fill_pos", "fill_share", "factor", zero(F.col("leagues")).alias("leagues"), F.coalesce("observed", F.lit(0.0)).alias("observed"), gap.alias("gap"), (F.col("odd_rows") + zero(F.col("odd_leagues"))).alias("odd"))


@query(
    "median_imputation",
    "L06",
    sql("SELECT fixture_id, ROUND(COALESCE(pos_h, (SELECT quantile_cont(pos_h, 0.5) FROM matches)), 6) AS pos_h, ROUND(COALESCE(CAST(shots_h AS DOUBLE), (SELECT quantile_cont(shots_h, 0.5) FROM matches)), 6) AS shots_h FROM matches"),
)
def _(t: Tables):
    return xg.impute_medians(t.matches.select("fixture_id", "pos_h", "shots_h"), ["pos_h", "shots_h"], {"pos_h": 50.0, "shots_h": 10.0})


def isotonic_report(early, later, model, prob: str, label: str, out: str):
    """Rows and label sums of the fit, the same sum from the curve, breaks of its order, and later rows outside its range."""
    fitted = model.transform(early)
    steps = fitted.groupBy(prob).agg(F.min(out).alias("_fit")).select(F.col(prob).alias("x"), "_fit")
    # a curve that falls anywhere puts a smaller value at a larger probability into some pair of neighbours
    breaks = steps.withColumn("part", F.floor(F.col("x") * 64)).selectExpr("_fit < max(_fit) OVER (PARTITION BY part ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1e-12 AS b").agg(F.count_if("b").alias("breaks"))
    ends = fitted.agg(F.count(F.lit(1)).alias("fit_rows"), F.round(F.sum(label), 4).alias("label_sum"), F.round(F.sum(out), 4).alias("curve_sum"), F.min(out).alias("lo"), F.max(out).alias("hi"))
    scored = model.transform(later).agg(F.count(F.lit(1)).alias("later_rows"), F.min(out).alias("a"), F.max(out).alias("b"))
    one = lambda df, c: df.select(c).scalar()
    return ends.select("fit_rows", "label_sum", "curve_sum", one(breaks, "breaks").alias("breaks"), one(scored, "later_rows").alias("later_rows"), ((one(scored, "a") < F.col("lo")) | (one(scored, "b") > F.col("hi"))).alias("outside"))


ISO = "COUNT(*) FILTER (kickoff < {c}) AS fit_rows, CAST(SUM({y}) FILTER (kickoff < {c}) AS DOUBLE) AS label_sum, CAST(SUM({y}) FILTER (kickoff < {c}) AS DOUBLE) AS curve_sum, CAST(0 AS BIGINT) AS breaks, COUNT(*) FILTER (kickoff >= {c}) AS later_rows, FALSE AS outside"


@query("isotonic_calibration", "L08 L10", sql("SELECT " + ISO.format(c=CUT, y="CAST(ft_home + ft_away > 2.5 AS INT)") + ", FALSE AS degenerate FROM priced", "priced"))
def _(t: Tables):
    df = labelled(t)
    model = ml.fit_isotonic(df.filter(before()), "p_over", "over")
    flat = ml.is_degenerate(model, "p_over", t.spark).select("degenerate").scalar()
    return isotonic_report(df.filter(before()), df.filter(~before()), model, "p_over", "over", "p_cal").withColumn("degenerate", flat)


@query(
    "platt_calibration",
    "L09",
    sql(f"SELECT COUNT(*) FILTER (kickoff >= {CUT}) AS later_rows, CAST(0 AS BIGINT) AS odd, CAST(0 AS DOUBLE) AS score_h, CAST(0 AS DOUBLE) AS slope_h, CAST(0 AS DOUBLE) AS score_d, CAST(0 AS DOUBLE) AS slope_d, CAST(0 AS DOUBLE) AS score_a, CAST(0 AS DOUBLE) AS slope_a FROM priced", "priced"),
)
def _(t: Tables):
    """Both score equations of each class over the early rows are zero; later rows sum to one."""
    den = F.col("mu_total") + 0.6
    h, a = F.col("ft_home"), F.col("ft_away")
    df = t.priced.withColumns(
        {
            "ph": F.col("mu_home") / den, "pd": F.lit(0.6) / den, "pa": F.col("mu_away") / den,
            "yh": (h > a).cast("double"), "yd": (h == a).cast("double"), "ya": (h < a).cast("double"),
        }
    )
    out = ml.calibrate_three_way(df.filter(before()), df, {"ph": "yh", "pd": "yd", "pa": "ya"})
    early = lambda c: F.round(F.avg(F.when(before(), c)), 4)
    off = {k: F.col(f"p{k}_one") - F.col(f"y{k}") for k in "hda"}
    scores = [x for k in "hda" for x in (early(off[k]).alias(f"score_{k}"), early(off[k] * F.col(f"p{k}")).alias(f"slope_{k}"))]
    good = F.abs(F.col("ph_cal") + F.col("pd_cal") + F.col("pa_cal") - 1) < 1e-9
    return out.agg(F.count_if(~before()).alias("later_rows"), flag(good).alias("odd"), *scores)


@query(
    "interval_calibration",
    "L11",
    sql(
        "SELECT '0-1' AS span, " + ISO.format(c=CUT, y="CAST(ft_home + ft_away BETWEEN 0 AND 1 AS INT)") + " FROM priced UNION ALL SELECT '2-3', " + ISO.format(c=CUT, y="CAST(ft_home + ft_away BETWEEN 2 AND 3 AS INT)")
        + " FROM priced UNION ALL SELECT '4-6', " + ISO.format(c=CUT, y="CAST(ft_home + ft_away BETWEEN 4 AND 6 AS INT)") + " FROM priced",
        "priced",
    ),
)
def _(t: Tables):
    total = F.col("ft_home") + F.col("ft_away")
    out = None
    for lo, hi in ((0, 1), (2, 3), (4, 6)):
        p = F.exp(-F.col("mu_total")) * sum((F.pow("mu_total", F.lit(k)) / F.factorial(F.lit(k)) for k in range(lo, hi + 1)), F.lit(0.0))
        df = t.priced.select("fixture_id", "kickoff", p.alias("p"), total.between(lo, hi).cast("double").alias("y"))
        early, later = df.filter(before()), df.filter(~before())
        part = isotonic_report(early, later, ml.fit_isotonic(early, "p", "y"), "p", "y", "p_cal").select(F.lit(f"{lo}-{hi}").alias("span"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "count_trees",
    "L12",
    sql("SELECT COUNT(*) AS rows, FALSE AS odd FROM inputs WHERE epoch(kickoff) > (SELECT quantile_cont(epoch(kickoff), 0.8) FROM inputs)", "scored sides", INPUTS_CTE),
)
def _(t: Tables):
    """Trees on form before the match; the error of the later fifth is near that of the mean or below."""
    out = ml.count_trees(inputs(t), INPUTS, "ft_home", "kickoff")
    return out.select("rows", (~((F.col("rmse") > 0) & (F.col("rmse") < 1.25 * F.col("rmse_mean")))).alias("odd"))


@query(
    "league_combiner",
    "L13",
    sql(f"SELECT COUNT(*) FILTER (kickoff < {CUT}) AS early_rows, CAST(0 AS DOUBLE) AS score_base, CAST(0 AS DOUBLE) AS score_attack, CAST(0 AS DOUBLE) AS score_defence, CAST(0 AS DOUBLE) AS score_set_play, CAST(0 AS BIGINT) AS odd FROM inputs", "scored sides", INPUTS_CTE),
)
def _(t: Tables):
    """Score equations of the ridge over the early rows: mean residual, and mean residual x group minus the penalty's pull."""
    groups = {"attack": ["shots_for_l5_home", "sot_for_l5_home"], "defence": ["shots_for_l5_away", "sot_for_l5_away"], "set_play": ["corners_for_l5_home", "corners_for_l5_away"]}
    df = stored(inputs(t).select("fixture_id", "kickoff", "league", "ft_home", *[c for cols in groups.values() for c in cols]))  # read four times
    out = ml.ridge_combiner(df.filter(before()), df, groups, "ft_home")
    off = F.col("ft_home") - F.col("mu_global")
    early = lambda c: F.avg(F.when(before(), c))
    shrunk = F.abs(F.col("league_shift")) <= 5.0
    scores = [F.round(early(off * F.col(f"z_{g}")) - F.max(f"pull_{g}"), 6).alias(f"score_{g}") for g in groups]
    return out.agg(F.count_if(before()).alias("early_rows"), F.round(early(off), 6).alias("score_base"), *scores, flag(shrunk & F.col("mu").isNotNull()).alias("odd"))


@query(
    "decayed_strengths",
    "L14",
    sql(
        """SELECT side, team, rows, ROUND(goals, 6) AS goals, CAST(0 AS DOUBLE) AS score, COALESCE(later, 0) AS later_rows, CAST(0 AS BIGINT) AS odd FROM
        (SELECT 'attack' AS side, team, COUNT(*) AS rows, SUM(w * gf) AS goals FROM e GROUP BY team UNION ALL SELECT 'defence', opp, COUNT(*), SUM(w * gf) FROM e GROUP BY opp)
        LEFT JOIN (SELECT 'attack' AS side, team, COUNT(*) AS later FROM sides WHERE kickoff >= TIMESTAMP '2000-01-01' GROUP BY team
          UNION ALL SELECT 'defence', opp, COUNT(*) FROM sides WHERE kickoff >= TIMESTAMP '2000-01-01' GROUP BY opp) USING (side, team)""",
        "sides",
        "e AS (SELECT *, exp(-date_diff('day', CAST(kickoff AS DATE), DATE '2000-01-01') / 180e0) AS w FROM sides WHERE gf IS NOT NULL AND kickoff < TIMESTAMP '2000-01-01')",
    ),
)
def _(t: Tables):
    """Score equations of every team's attack and defence over the rows before the cut, and the means of the rows after it."""
    cells = cut_lineage(ml.weighed_cells(t.sides, F.lit(MIDDLE).cast("date")))
    attack, defence, venue = ml.decayed_strengths(cells)
    fitted = ml.strength_means(cells, attack, defence, venue)
    later = ml.strength_means(t.sides.filter(~before(MIDDLE)), attack, defence, venue)
    parts = []
    for side, key in (("attack", "team"), ("defence", "opp")):
        seen = fitted.groupBy(F.col(key).alias("team")).agg(F.sum("rows").alias("rows"), F.sum("wy").alias("goals"), F.round(F.sum(F.col("wy") - F.col("w") * F.col("mu")), 6).alias("score"))
        ahead = later.groupBy(F.col(key).alias("team")).agg(F.count(F.lit(1)).alias("later_rows"), flag(F.col("mu").between(0.0, 60.0)).alias("odd"))
        zero = F.lit(0).cast("long")
        parts.append(seen.join(ahead, "team", "left").select(F.lit(side).alias("side"), "team", "rows", "goals", "score", F.coalesce("later_rows", zero).alias("later_rows"), F.coalesce("odd", zero).alias("odd")))
    return parts[0].unionByName(parts[1])


@query(
    "shot_probability",
    "L15",
    sql(
        f"""SELECT COUNT(*) FILTER (kickoff >= TIMESTAMP '{MIDDLE}' AND kickoff < {CUT}) AS fit_rows, CAST(COUNT(*) FILTER (kickoff >= TIMESTAMP '{MIDDLE}' AND kickoff < {CUT} AND result = 'Goal') AS DOUBLE) AS label_sum,
        CAST(COUNT(*) FILTER (kickoff >= TIMESTAMP '{MIDDLE}' AND kickoff < {CUT} AND result = 'Goal') AS DOUBLE) AS curve_sum, COUNT(*) FILTER (kickoff >= {CUT}) AS later_rows, CAST(0 AS BIGINT) AS odd FROM shots JOIN matches USING (fixture_id)""",
        "",
        "shots AS (SELECT l_orderkey AS fixture_id, CASE WHEN l_returnflag = 'A' THEN 'Goal' ELSE 'Saved' END AS result FROM lineitem)",
    ),
)
def _(t: Tables):
    """Trees before the middle cut, isotonic curve between the cuts (its sum is the goals there), scores for later shots."""
    s = shots(t).join(t.matches.select("fixture_id", "kickoff"), "fixture_id")
    s = s.withColumns({"dist": shot_distance_m("x", "y"), "angle": shot_angle_deg("x", "y"), "goal": (F.col("result") == "Goal").cast("double")})
    s = stored(s.select("kickoff", "dist", "angle", "shot_type", "situation", "goal"))  # read by every pass of the fit
    middle = ~before(MIDDLE) & before()
    out = ml.shot_classifier(s.filter(before(MIDDLE)), s.filter(middle), s.filter(~before(MIDDLE)), ["dist", "angle"], ["shot_type", "situation"], "goal")
    return out.agg(
        F.count_if(middle).alias("fit_rows"), F.round(F.sum(F.when(middle, F.col("goal"))), 4).alias("label_sum"), F.round(F.sum(F.when(middle, F.col("p_goal"))), 4).alias("curve_sum"),
        F.count_if(~before()).alias("later_rows"), flag(F.col("p_goal").between(0.0, 1.0)).alias("odd"),
    )


@query(
    "corner_line",
    "L16",
    sql(f"SELECT COUNT(*) AS rows, ROUND(AVG(CAST(corners_h + corners_a > 9.5 AS INT)), 6) AS base_rate, FALSE AS odd FROM inputs WHERE kickoff >= {CUT}", "scored sides", INPUTS_CTE),
)
def _(t: Tables):
    out = ml.line_classifier(inputs(t), INPUTS, F.col("corners_h") + F.col("corners_a"), 9.5, ~before())
    return out.select("rows", "base_rate", (~(F.col("accuracy").between(0, 1) & F.col("auc").between(0, 1))).alias("odd"))


FEATURES = ["shots_h", "shots_a", "sot_h", "corners_h", "corners_a", "sot_a"]


@query(
    "feature_selection",
    "L17",
    sql(
        """SELECT f.feature, ROUND(f.variance, 6) AS variance, f.variance > 1e-6 AND NOT EXISTS (SELECT 1 FROM rho WHERE rho.b = f.feature AND abs(rho.r) >= 0.95) AS kept FROM
        (SELECT feature, var_samp(v) AS variance FROM long GROUP BY feature) f""",
        "scored",
        """full_rows AS (SELECT * FROM scored WHERE shots_h IS NOT NULL AND shots_a IS NOT NULL AND sot_h IS NOT NULL AND corners_h IS NOT NULL AND corners_a IS NOT NULL AND sot_a IS NOT NULL),
        long AS (SELECT fixture_id, feature, CAST(v AS DOUBLE) AS v, pos FROM (SELECT fixture_id, unnest(['shots_h', 'shots_a', 'sot_h', 'corners_h', 'corners_a', 'sot_a']) AS feature, unnest([shots_h, shots_a, sot_h, corners_h, corners_a, sot_a]) AS v, unnest([1, 2, 3, 4, 5, 6]) AS pos FROM full_rows)),
        ranked AS (SELECT *, RANK() OVER (PARTITION BY feature ORDER BY v) + (COUNT(*) OVER (PARTITION BY feature, v) - 1) / 2e0 AS k FROM long),
        rho AS (SELECT a.feature AS a, b.feature AS b, corr(a.k, b.k) AS r FROM ranked a JOIN ranked b ON a.fixture_id = b.fixture_id AND a.pos < b.pos GROUP BY ALL)""",
    ),
)
def _(t: Tables):
    return ml.select_features(t.scored.dropna(subset=FEATURES), FEATURES)


@query(
    "classifier_ensemble",
    "L18",
    sql(f"SELECT fixture_id, FALSE AS odd FROM inputs WHERE kickoff >= {CUT}", "scored sides", INPUTS_CTE),
)
def _(t: Tables):
    df = inputs(t).select("fixture_id", "kickoff", *INPUTS, (F.col("ft_home") + F.col("ft_away") > 2.5).cast("double").alias("over"))
    df = stored(df)  # every fit and fold reads it
    out = ml.ensemble(df.filter(before()), df.filter(~before()), INPUTS, "over")
    return out.select("fixture_id", (~F.col("p").between(0.0, 1.0)).alias("odd"))

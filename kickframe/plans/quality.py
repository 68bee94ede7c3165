"""Queries on audits and backtests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from kickframe.functions.cols import unix
from kickframe.operators import forms as fm
from kickframe.operators import quality as ql
from kickframe.operators import summaries as sm
from kickframe.operators.clean import parse_dates
from kickframe.operators.markets import p_under_25
from kickframe.operators.tops import top_k
from kickframe.plans.fixtures import CUTOFF, Tables, sql
from kickframe.plans.forms import PRESS_CTE
from kickframe.plans.joins import H2H_SQL
from kickframe.plans.picks import PICK_SQL, picks
from kickframe.plans.registry import query
from kickframe.plans.summaries import BETS_SQL


def ID():
    return F.col("fixture_id")


@query(
    "prediction_health",
    "Q02",
    sql(
        """SELECT *, null_probs = 0 AND bad_sums = 0 AND LEAST(press_share, xg_share, odds_share) >= 0.95 AS ok FROM (SELECT COUNT(*) AS rows, COUNT(*) FILTER (p_over IS NULL OR p_btts IS NULL) AS null_probs, COUNT(*) FILTER (abs(p_over + p_under - 1) > 1e-6) AS bad_sums,
        ROUND(AVG(CAST(press_n_h > 0 AND press_n_a > 0 AS DOUBLE)), 6) AS press_share, ROUND(AVG(CAST(xg_n_h > 0 AND xg_n_a > 0 AS DOUBLE)), 6) AS xg_share, ROUND(AVG(CAST(odds_over IS NOT NULL AND odds_under IS NOT NULL AS DOUBLE)), 6) AS odds_share FROM priced)""",
        "priced",
    ),
)
def _(t: Tables):
    return ql.prediction_health(t.priced)


@query(
    "skip_reconciliation",
    "Q03 S15",
    sql("SELECT COUNT(*) AS expected, COUNT(*) FILTER (fixture_id % 20 <> 0) AS produced, COUNT(*) FILTER (fixture_id % 20 = 0) AS skipped, COUNT(*) FILTER (fixture_id % 100 = 0) AS unknown_reasons, ROUND(COUNT(*) FILTER (fixture_id % 20 = 0) / COUNT(*), 6) AS skip_ratio, FALSE AS ok FROM matches"),
)
def _(t: Tables):
    skipped = t.matches.filter(ID() % 20 == 0).select("fixture_id", F.when(ID() % 100 == 0, "odd").otherwise("unknown_team").alias("reason"))
    return ql.reconcile_skips(t.matches, t.matches.filter(ID() % 20 != 0), skipped, ["unknown_team", "no_history"])


@query(
    "pressure_ranges",
    "Q05",
    sql(
        """SELECT 'press_index' AS "column", ROUND(MIN(press_index), 6) AS min, ROUND(MAX(press_index), 6) AS max, ROUND(AVG(press_index), 6) AS mean, COUNT(*) FILTER (press_index IS NULL) AS missing, COUNT(*) FILTER (press_index < 0.05 OR press_index > 0.95) AS outside FROM pidx
        UNION ALL SELECT 'dom_shots', ROUND(MIN(dom_shots), 6), ROUND(MAX(dom_shots), 6), ROUND(AVG(dom_shots), 6), COUNT(*) FILTER (dom_shots IS NULL), COUNT(*) FILTER (dom_shots < 0.05 OR dom_shots > 0.95) FROM pidx""",
        "sides",
        PRESS_CTE,
    ),
)
def _(t: Tables):
    return ql.ranges(fm.pressure_components(t.sides), ["press_index", "dom_shots"], 0.05, 0.95)


@query(
    "xg_sanity",
    "Q06 Q15",
    sql(
        """SELECT league, COUNT(*) AS rows, COUNT(*) FILTER (x < 0) AS negative, COUNT(*) FILTER (x > 3) AS implausible, COUNT(*) FILTER (x IS NULL) AS missing FROM (SELECT league, shots_h * 0.05e0 + sot_h * 0.2e0 - 0.5e0 AS x FROM matches) GROUP BY league"""
    ),
)
def _(t: Tables):
    x = F.col("shots_h") * 0.05 + F.col("sot_h") * 0.2 - 0.5
    return ql.check_counts(t.matches.withColumn("x", x), {"negative": F.col("x") < 0, "implausible": F.col("x") > 3, "missing": F.col("x").isNull()}, ["league"])


NULL_COLS = ["ft_home", "shots_h", "pos_h", "odds_over", "corners_a"]


@query(
    "null_rates",
    "Q07 P39",
    sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", ROUND(AVG(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END), 6) AS null_rate FROM matches" for c in NULL_COLS)),
)
def _(t: Tables):
    return ql.null_rates(t.matches, NULL_COLS)


@query(
    "duplicate_keys",
    "Q07 Q16",
    sql("SELECT CAST(CAST(kickoff AS DATE) AS VARCHAR) AS day, home, away, COUNT(*) AS n FROM matches GROUP BY ALL HAVING COUNT(*) > 1 UNION ALL SELECT 'total', '', '', COUNT(*) FROM matches"),
)
def _(t: Tables):
    dup = ql.duplicates(t.matches.withColumn("day", F.date_format("kickoff", "yyyy-MM-dd")), ["day", "home", "away"])
    total = t.matches.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("day"), F.lit("").alias("home"), F.lit("").alias("away"), "n")
    return dup.unionByName(total)


@query(
    "mean_coherence",
    "Q08",
    sql(
        """SELECT COUNT(*) AS rows, COUNT(*) FILTER (mu_home < 0.2 OR mu_away < 0.2 OR mu_home > 3.5 OR mu_away > 3.5) AS mu_outside, COUNT(*) FILTER ((mu_total > 2.674) <> (p_over > 0.5)) AS side_mismatch,
        COUNT(*) FILTER (CAST(mu_total < 2.3 AS INT) + CAST(mu_home < 1.2 AND mu_away < 1.2 AS INT) + sterile + CAST(p_under > 0.52 AS INT) >= 2) AS low_scoring FROM priced""",
        "priced",
    ),
)
def _(t: Tables):
    from kickframe.operators.picks import PickRules, low_scoring

    out = (F.least("mu_home", "mu_away") < 0.2) | (F.greatest("mu_home", "mu_away") > 3.5)
    checks = {"mu_outside": out, "side_mismatch": (F.col("mu_total") > 2.674) != (F.col("p_over") > 0.5), "low_scoring": low_scoring(PickRules())}
    return ql.check_counts(t.priced, checks)


@query(
    "stage_row_chain",
    "Q09",
    sql(
        """SELECT CAST(step AS BIGINT) AS step, stage, rows, ROUND((p - rows) / p, 6) AS "drop", COALESCE((p - rows) / p > 0.05, FALSE) AS fails FROM (SELECT *, LAG(rows) OVER (ORDER BY step) AS p FROM (SELECT 0 AS step, 'history' AS stage, COUNT(*) AS rows FROM matches
        UNION ALL SELECT 1, 'scored', COUNT(*) FROM matches WHERE ft_home IS NOT NULL UNION ALL SELECT 2, 'with_stats', COUNT(*) FROM matches WHERE ft_home IS NOT NULL AND pos_h IS NOT NULL))"""
    ),
)
def _(t: Tables):
    return ql.stage_drops([("history", t.matches), ("scored", t.scored), ("with_stats", t.scored.filter("pos_h IS NOT NULL"))])


@query(
    "detailed_coverage",
    "Q11",
    sql(
        f"""SELECT league, COUNT(*) AS teams, COUNT(*) FILTER (n < 60) AS few_matches, COUNT(*) FILTER (recent < 8) AS thin_recent FROM (SELECT league, team, COUNT(*) AS n, COUNT(*) FILTER (k <= 10 AND pos_for IS NOT NULL AND shots_for IS NOT NULL) AS recent FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY league, team ORDER BY kickoff DESC, fixture_id DESC) AS k FROM sides WHERE kickoff < TIMESTAMP '{CUTOFF}') GROUP BY league, team) GROUP BY league""",
        "sides",
    ),
)
def _(t: Tables):
    past = t.sides.filter(F.col("kickoff") < F.lit(CUTOFF).cast("timestamp_ntz"))
    n = past.groupBy("league", "team").agg(F.count(F.lit(1)).alias("n"))
    recent = top_k(past, ["league", "team"], [F.desc("kickoff"), F.desc("fixture_id")], 10)
    ok = F.col("pos_for").isNotNull() & F.col("shots_for").isNotNull()
    r = recent.groupBy("league", "team").agg(F.count_if(ok).alias("recent"))
    return n.join(r, ["league", "team"]).groupBy("league").agg(
        F.count(F.lit(1)).alias("teams"), F.count_if(F.col("n") < 60).alias("few_matches"), F.count_if(F.col("recent") < 8).alias("thin_recent")
    )


@query(
    "input_coverage",
    "Q11",
    sql(
        """SELECT league, COUNT(*) AS rows, COUNT(elo) AS rated, COUNT(*) FILTER (shots_for IS NOT NULL AND shots_against IS NOT NULL AND sot_for IS NOT NULL AND sot_against IS NOT NULL AND corners_for IS NOT NULL AND corners_against IS NOT NULL AND pos_for IS NOT NULL AND pos_against IS NOT NULL) AS pressure,
        COUNT(*) FILTER (shots_for IS NOT NULL AND sot_for IS NOT NULL) AS xg, ROUND(AVG(CASE WHEN k <= 5 THEN CASE WHEN pos_for IS NOT NULL AND shots_for IS NOT NULL THEN 1e0 ELSE 0e0 END END), 6) AS recent_share FROM
        (SELECT s.*, CASE venue WHEN 'home' THEN elo_home ELSE elo_away END AS elo, ROW_NUMBER() OVER (PARTITION BY s.league, s.team ORDER BY s.kickoff DESC, fixture_id DESC) AS k FROM sides s JOIN rated r USING (fixture_id)) GROUP BY league""",
        "sides rated",
    ),
)
def _(t: Tables):
    """Side rows with ratings, pressure inputs and expected-goal inputs per league, and the share of complete rows among each team's last five."""
    from kickframe.plans.forms import rated_sides

    sides = fm.pressure_components(rated_sides(t))
    has = lambda *cols: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    counts = sides.groupBy("league").agg(F.count(F.lit(1)).alias("rows"), F.count("own_elo").alias("rated"), F.count_if(F.col("stats_present") > 0).alias("pressure"), F.count_if(has("shots_for", "sot_for")).alias("xg"))
    last = top_k(sides, ["league", "team"], [F.desc("kickoff"), F.desc("fixture_id")], 5)
    return counts.join(last.groupBy("league").agg(F.avg(has("pos_for", "shots_for").cast("double")).alias("recent_share")), "league")


@query(
    "head_to_head_audit",
    "Q15",
    sql(
        """SELECT COUNT(*) AS rows, SUM(h2h_usable)::BIGINT AS usable, COUNT(*) FILTER (h2h_matches = 0) AS unmet, ROUND(AVG(h2h_matches), 6) AS mean_meetings, MAX(h2h_matches)::BIGINT AS most_meetings,
        COUNT(*) FILTER (h2h_home_win_rate NOT BETWEEN 0 AND 1 OR h2h_btts_rate NOT BETWEEN 0 AND 1 OR h2h_goals_avg < 0) AS out_of_range, COUNT(*) FILTER (h2h_matches = 0 AND (h2h_home_win_rate <> 0.5 OR h2h_goals_avg <> 2.5)) AS off_default FROM h""",
        "scored",
        f"h AS ({H2H_SQL})",
    ),
)
def _(t: Tables):
    from kickframe.operators import joins as jn

    h = jn.head_to_head(t.matches)
    none = F.col("h2h_matches") == 0
    off = ~F.col("h2h_home_win_rate").between(0, 1) | ~F.col("h2h_btts_rate").between(0, 1) | (F.col("h2h_goals_avg") < 0)
    return h.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("h2h_usable").alias("usable"), F.count_if(none).alias("unmet"), F.avg("h2h_matches").alias("mean_meetings"), F.max("h2h_matches").alias("most_meetings"),
        F.count_if(off).alias("out_of_range"), F.count_if(none & ((F.col("h2h_home_win_rate") != 0.5) | (F.col("h2h_goals_avg") != 2.5))).alias("off_default"),
    )


@query("price_invariance", "Q17", sql("SELECT COUNT(*) AS rows, TRUE AS same_without_prices, FALSE AS same_with_other_means FROM priced", "priced"))
def _(t: Tables):
    """Market probabilities must not move when all prices are taken away, and must when a mean does; order-free digests."""
    from kickframe.operators import markets as mk
    from kickframe.sources import readers as rd

    prices = [c for c in t.priced.columns if c.startswith("odds_")]
    bare = t.priced.withColumns({c: F.lit(None).cast("double") for c in prices})
    moved = t.priced.withColumn("mu_home", F.col("mu_home") * 1.01)

    def digest(df):
        probs = mk.market_probs(df, "mu_home", "mu_away", F.lit(0.1), F.lit(0.05), F.lit(-0.05))
        cols = ["fixture_id", *[c for c in probs.columns if c not in df.columns]]
        return rd.fingerprint(probs, cols)

    a, b, c = digest(t.priced), digest(bare).select(F.col("digest").alias("d2")), digest(moved).select(F.col("digest").alias("d3"))
    return a.select("rows", (F.col("digest") == b.select("d2").scalar()).alias("same_without_prices"), (F.col("digest") == c.select("d3").scalar()).alias("same_with_other_means"))


@query(
    "backtest_smell",
    "Q12",
    sql(
        """SELECT league, ROUND(acc, 6) AS accuracy, stamps, acc > 0.9 OR acc < 0.3 AS suspicious FROM (SELECT league, AVG(CAST((p_over >= 0.5) = (ft_home + ft_away > 2.5) AS DOUBLE)) AS acc, COUNT(DISTINCT date_trunc('month', kickoff)) AS stamps FROM priced GROUP BY league)""",
        "priced",
    ),
)
def _(t: Tables):
    hit = ((F.col("p_over") >= 0.5) == (F.col("ft_home") + F.col("ft_away") > 2.5)).cast("double")
    g = t.priced.groupBy("league").agg(F.avg(hit).alias("accuracy"), F.count_distinct(F.date_trunc("month", "kickoff")).alias("stamps"))
    return g.withColumn("suspicious", (F.col("accuracy") > 0.9) | (F.col("accuracy") < 0.3))


@query(
    "leakage_scan",
    "Q13",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, ROUND(AVG(CAST({c} = ft_home AS DOUBLE)), 6) AS equal_rate, ROUND(ABS(CORR({c}, ft_home)), 6) AS abs_corr, AVG(CAST({c} = ft_home AS DOUBLE)) >= 0.999 OR ABS(CORR({c}, ft_home)) >= 0.999 AS leaks FROM x"
            for c in ("shots_h", "corners_h", "goals_copy")
        ),
        "",
        "x AS (SELECT *, ft_home AS goals_copy FROM matches)",
    ),
)
def _(t: Tables):
    return ql.leakage_scan(t.matches.withColumn("goals_copy", F.col("ft_home")), ["shots_h", "corners_h", "goals_copy"], "ft_home")


@query(
    "pick_contract",
    "Q14",
    sql(
        """SELECT gate_tier, COUNT(*) AS rows, COUNT(*) FILTER (p_model <= 0.52) AS weak_prob, COUNT(*) FILTER (odds <= 1.7) AS low_odds, COUNT(*) FILTER (pick_rank > 5) AS over_quota, COUNT(*) FILTER (abs(ev - (p_model * odds - 1)) > 1e-9) AS bad_ev FROM picks GROUP BY gate_tier""",
        "priced",
        PICK_SQL,
    ),
)
def _(t: Tables):
    checks = {
        "weak_prob": F.col("p_model") <= 0.52,
        "low_odds": F.col("odds") <= 1.7,
        "over_quota": F.col("pick_rank") > 5,
        "bad_ev": F.abs(F.col("ev") - (F.col("p_model") * F.col("odds") - 1)) > 1e-9,
    }
    return ql.check_counts(picks(t), checks, ["gate_tier"])


@query(
    "fixture_doctor",
    "Q16",
    sql("SELECT fixture_id, CASE WHEN fixture_id % 31 = 0 THEN 'bad_date' ELSE 'unknown_team' END AS problem FROM matches WHERE fixture_id % 31 = 0 OR fixture_id % 37 = 0"),
)
def _(t: Tables):
    feed = t.matches.select(
        "fixture_id",
        F.when(ID() % 37 == 0, "nobody").otherwise(F.col("home")).alias("home"),
        F.when(ID() % 31 == 0, "2001-13-45").otherwise(F.date_format("kickoff", "yyyy-MM-dd")).alias("raw"),
    )
    known = t.matches.select("home").distinct()
    bad_date = parse_dates(feed, "raw", "day").filter("day IS NULL").select("fixture_id", F.lit("bad_date").alias("problem"))
    stranger = feed.join(known, "home", "left_anti").select("fixture_id", F.lit("unknown_team").alias("problem"))
    both = bad_date.unionByName(stranger)
    return both.groupBy("fixture_id").agg(F.min("problem").alias("problem"))


@query(
    "time_travel_backtest",
    "L19 J07 J11",
    sql(
        """SELECT b.fixture_id, ROUND(mu, 6) AS mu_total, ROUND(exp(-mu) * (1 + mu + mu * mu / 2), 6) AS p_under, (exp(-mu) * (1 + mu + mu * mu / 2) > 0.5) = (h + a < 2.5) AS hit FROM
        (SELECT m.fixture_id, m.ft_home AS h, m.ft_away AS a, COALESCE(hs.g / NULLIF(hs.n, 0), 1.35) + COALESCE(aw.g / NULLIF(aw.n, 0), 1.15) AS mu FROM scored m
          LEFT JOIN (SELECT m.fixture_id, SUM(p.ft_home) AS g, COUNT(p.fixture_id) AS n FROM scored m LEFT JOIN scored p ON p.home = m.home AND CAST(p.kickoff AS DATE) < CAST(m.kickoff AS DATE) GROUP BY ALL) hs USING (fixture_id)
          LEFT JOIN (SELECT m.fixture_id, SUM(p.ft_away) AS g, COUNT(p.fixture_id) AS n FROM scored m LEFT JOIN scored p ON p.away = m.away AND CAST(p.kickoff AS DATE) < CAST(m.kickoff AS DATE) GROUP BY ALL) aw USING (fixture_id)) b""",
        "scored",
    ),
)
def _(t: Tables):
    """Every match seen from the end of the day before, all as-of dates in one job."""
    from kickframe.operators.ordered import running

    sides = t.sides.filter("gf IS NOT NULL AND ga IS NOT NULL").withColumn("day", F.to_date("kickoff"))
    daily = sides.groupBy("team", "venue", "day").agg(F.sum("gf").alias("g"), F.count(F.lit(1)).alias("n"))
    sums = {"g_before": F.col("g"), "n_before": F.col("n")}
    state = running(daily, ["team", "venue"], ["day"], sums, unix("day"))
    j = sides.join(state.select("team", "venue", "day", "g_before", "n_before"), ["team", "venue", "day"])
    rate = F.try_divide("g_before", "n_before")
    own = F.coalesce(rate, F.when(F.col("venue") == "home", 1.35).otherwise(1.15))
    mu = j.groupBy("fixture_id").agg(F.sum(own).alias("mu_total"), F.max(F.when(F.col("venue") == "home", F.col("gf") + F.col("ga"))).alias("total"))
    out = mu.withColumn("p_under", p_under_25("mu_total"))
    return out.select("fixture_id", "mu_total", "p_under", ((F.col("p_under") > 0.5) == (F.col("total") < 2.5)).alias("hit"))


@query(
    "shrink_grid_search",
    "L22",
    sql(
        """SELECT league, ROUND(w, 6) AS weight, ROUND(brier, 6) AS brier FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY league ORDER BY round(brier, 12), w) AS k FROM (SELECT league, w, AVG(pow((1 - w) * p_over + w * 0.5 - CAST(ft_home + ft_away > 2.5 AS INT), 2)) AS brier
        FROM priced, (SELECT i / 10e0 AS w FROM range(0, 11) r(i)) GROUP BY league, w)) WHERE k = 1""",
        "priced",
    ),
)
def _(t: Tables):
    """Brier score is quadratic in the weight, so four sums per league answer every grid point."""
    y = (F.col("ft_home") + F.col("ft_away") > 2.5).cast("double")
    a, b = F.col("p_over") - y, F.lit(0.5) - F.col("p_over")
    s = t.priced.groupBy("league").agg(F.avg(a * a).alias("aa"), F.avg(a * b).alias("ab"), F.avg(b * b).alias("bb"))
    grid = s.withColumn("weight", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / 10.0)))
    w = F.col("weight")
    scored = grid.withColumn("brier", F.col("aa") + 2 * w * F.col("ab") + w * w * F.col("bb"))
    return scored.groupBy("league").agg(F.min_by(F.struct("weight", "brier"), F.struct(F.round("brier", 12), w)).alias("b")).select("league", "b.*")


@query(
    "bet_backtest",
    "L23 A27",
    sql(
        """SELECT market, COUNT(*) AS bets, ROUND(SUM(CASE WHEN hit THEN odds - 1 ELSE -1 END), 6) AS profit, ROUND(1000 * exp(SUM(ln(1 + 0.02 * CASE WHEN hit THEN odds - 1 ELSE -1 END))), 6) AS compounded FROM bets WHERE p * odds - 1 >= 0.04 AND p >= 0.55 GROUP BY market""",
        "priced",
        BETS_SQL,
    ),
)
def _(t: Tables):
    from kickframe.plans.summaries import bets

    profit = F.when(F.col("hit"), F.col("odds") - 1).otherwise(F.lit(-1.0))
    b = bets(t).filter((F.col("ev") >= 0.04) & (F.col("p") >= 0.55)).withColumn("profit", profit)
    return b.groupBy("market").agg(
        F.count(F.lit(1)).alias("bets"), F.sum("profit").alias("profit"), (1000 * F.exp(F.sum(F.ln(1 + 0.02 * F.col("profit"))))).alias("compounded")
    )


@query(
    "candidate_vs_baseline",
    "L24 J12",
    sql(
        """SELECT metric, ROUND(a, 6) AS baseline, ROUND(b, 6) AS candidate, ROUND(b - a, 6) AS delta FROM (SELECT 'side_rmse' AS metric, sqrt(AVG(pow(m1 - y, 2))) AS a, sqrt(AVG(pow(m2 - y, 2))) AS b FROM s UNION ALL SELECT 'poisson_nll', AVG(m1 - y * ln(m1)), AVG(m2 - y * ln(m2)) FROM s)""",
        "priced",
        "s AS (SELECT mu_home AS m1, 0.5 * mu_home + 0.7 AS m2, ft_home AS y FROM priced UNION ALL SELECT mu_away, 0.5 * mu_away + 0.7, ft_away FROM priced)",
    ),
)
def _(t: Tables):
    df = t.priced.withColumns({"c_home": 0.5 * F.col("mu_home") + 0.7, "c_away": 0.5 * F.col("mu_away") + 0.7})
    goals = ("ft_home", "ft_away")
    base, cand = sm.side_errors(df, [], ("mu_home", "mu_away"), goals), sm.side_errors(df, [], ("c_home", "c_away"), goals)
    metrics = ["side_rmse", "poisson_nll"]
    long = lambda d, name: d.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics])))
    return long(base, "baseline").join(long(cand, "candidate"), "metric").withColumn("delta", F.col("candidate") - F.col("baseline"))


@query(
    "recent_results",
    "T09 A20 J11",
    sql(
        """SELECT fixture_id, home, away, CAST(m.ft_home AS BIGINT) AS ft_home, ROUND(p.p_over, 6) AS p_over FROM matches m LEFT JOIN priced p USING (fixture_id, home, away) WHERE CAST(m.kickoff AS DATE) IN (SELECT DISTINCT CAST(kickoff AS DATE) AS d FROM matches ORDER BY d DESC LIMIT 3)""",
        "priced",
    ),
)
def _(t: Tables):
    from kickframe.operators.tops import last_n_dates

    recent = last_n_dates(t.matches, "kickoff", 3)
    return recent.join(t.priced.select("fixture_id", "p_over"), "fixture_id", "left").select("fixture_id", "home", "away", "ft_home", "p_over")

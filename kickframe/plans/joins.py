"""Queries on joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.operators import joins as jn
from kickframe.operators.clean import normalise_team
from kickframe.plans.clean import CODES_SQL, coded, registry_of
from kickframe.plans.fixtures import CUTOFF, Tables, sql
from kickframe.plans.forms import rated_sides
from kickframe.plans.registry import query


def ID():
    return F.col("fixture_id")


def cut():
    return F.lit(CUTOFF).cast("timestamp_ntz")


@query(
    "asof_state",
    "J07 L19",
    sql(
        """SELECT fixture_id, team, CAST(p.gf AS BIGINT) AS gf, CAST(p.shots AS BIGINT) AS shots FROM sides s ASOF LEFT JOIN
        (SELECT team AS t2, venue AS v2, kickoff AS k2, MAX(gf) AS gf, MAX(shots_for) AS shots FROM sides WHERE gf IS NOT NULL GROUP BY ALL) p ON s.team = p.t2 AND s.venue = p.v2 AND s.kickoff > p.k2""",
        "sides",
    ),
)
def _(t: Tables):
    right = t.sides.filter("gf IS NOT NULL").groupBy("team", "venue", "kickoff").agg(F.max("gf").alias("gf"), F.max("shots_for").alias("shots"))
    left = t.sides.select("fixture_id", "team", "venue", "kickoff")
    return jn.asof_join(left, right, ["team", "venue"], "kickoff", ["gf", "shots"]).select("fixture_id", "team", "gf", "shots")


H2H_SQL = (
        """SELECT m.fixture_id, COUNT(p.h) AS h2h_matches, ROUND(COALESCE(AVG(CASE WHEN p.h > p.a THEN 1e0 WHEN p.h IS NOT NULL THEN 0e0 END), 0.5e0), 6) AS h2h_home_win_rate, ROUND(COALESCE(AVG(p.h + p.a), 2.5e0), 6) AS h2h_goals_avg,
        ROUND(COALESCE(AVG(CASE WHEN p.h > 0 AND p.a > 0 THEN 1e0 WHEN p.h IS NOT NULL THEN 0e0 END), 0.5e0), 6) AS h2h_btts_rate, CAST(COUNT(p.h) >= 3 AS BIGINT) AS h2h_usable
        FROM matches m LEFT JOIN (SELECT home AS x, away AS y, kickoff AS k, ft_home AS h, ft_away AS a FROM scored UNION ALL SELECT away, home, kickoff, ft_away, ft_home FROM scored) p
        ON m.home = p.x AND m.away = p.y AND p.k < m.kickoff AND p.k >= m.kickoff - INTERVAL 1825 DAY GROUP BY m.fixture_id"""
)


@query("head_to_head", "J09", sql(H2H_SQL, "scored"))
def _(t: Tables):
    cols = ["h2h_matches", "h2h_home_win_rate", "h2h_goals_avg", "h2h_btts_rate", "h2h_usable"]
    return jn.head_to_head(t.matches).select("fixture_id", *cols)


KERNEL_SQL = """s0 AS (SELECT fixture_id, kickoff, home AS team, 'home' AS venue, elo_away AS r, ft_home AS gf, ft_away AS ga FROM rated UNION ALL SELECT fixture_id, kickoff, away, 'away', elo_home, ft_away, ft_home FROM rated),
  k AS (SELECT s.fixture_id, s.team, s.venue, COUNT(w) AS n, SUM(w) AS w, SUM(w * gf) / SUM(w) AS f, SUM(w * ga) / SUM(w) AS a, SUM(w) * SUM(w) / SUM(w * w) AS neff, AVG(gf) AS bf, AVG(ga) AS ba FROM
    (SELECT s.fixture_id, s.team, s.venue, p.gf, p.ga, exp(-(p.r - s.r) * (p.r - s.r) / (2 * 60e0 * 60e0)) AS w FROM s0 s LEFT JOIN s0 p ON s.team = p.team AND s.venue = p.venue AND p.kickoff < s.kickoff AND p.gf IS NOT NULL) s GROUP BY ALL)"""
KERNEL_SELECT = """SELECT fixture_id, team, venue, ROUND(CASE WHEN n > 0 THEN CASE WHEN neff < 5 THEN LEAST(1, neff / 10) * f + (1 - LEAST(1, neff / 10)) * bf ELSE f END END, 6) AS gf_sim,
 ROUND(CASE WHEN n > 0 THEN CASE WHEN neff < 5 THEN LEAST(1, neff / 10) * a + (1 - LEAST(1, neff / 10)) * ba ELSE a END END, 6) AS ga_sim, ROUND(COALESCE(neff, 0), 6) AS neff FROM k"""


@query("kernel_similarity", "J08 W08 X06", sql(KERNEL_SELECT, "rated", KERNEL_SQL))
def _(t: Tables):
    return jn.kernel_history(rated_sides(t)).select("fixture_id", "team", "venue", "gf_sim", "ga_sim", "neff")


FEED_CTE = f"""coded AS (SELECT *, CAST(kickoff AS DATE) AS d, {CODES_SQL} AS ch, {CODES_SQL.replace("home", "away")} AS ca FROM matches),
  feed AS (SELECT d, CASE WHEN fixture_id % 3 = 0 THEN ch END AS ch, CASE WHEN fixture_id % 3 = 0 THEN ca END AS ca, CASE WHEN fixture_id % 3 = 1 THEN home ELSE '?' || home END AS hn,
    CASE WHEN fixture_id % 3 = 1 THEN away ELSE '?' || away END AS an, fixture_id + 1 AS stat, CASE WHEN fixture_id % 2 = 0 THEN corners_h END AS corners, ft_home + CAST(fixture_id % 10 = 0 AS INT) AS score,
    1 + CAST(fixture_id % 2 = 0 AND corners_h IS NOT NULL AS INT) + CAST(ft_home IS NOT NULL AS INT) AS full_cols FROM coded WHERE fixture_id % 3 < 2),
  by_code AS (SELECT d, ch, ca, arg_max({{'stat': stat, 'corners': corners, 'score': score}}, full_cols * CAST(1000000000 AS BIGINT) + stat) AS v FROM feed WHERE ch IS NOT NULL AND ca IS NOT NULL GROUP BY ALL),
  by_name AS (SELECT d, hn, an, arg_max({{'stat': stat, 'corners': corners, 'score': score}}, full_cols * CAST(1000000000 AS BIGINT) + stat) AS v FROM feed GROUP BY ALL)"""


def stats_feed(t: Tables):
    """A statistics feed of its own: codes on one third of the matches, usable names on another, none on the last; some scores are wrong."""
    i = ID()
    return coded(t).filter(i % 3 < 2).select(
        F.to_date("kickoff").alias("day"), F.when(i % 3 == 0, F.col("code_home")).alias("code_home"), F.when(i % 3 == 0, F.col("code_away")).alias("code_away"),
        F.when(i % 3 == 1, F.col("home")).otherwise(F.concat(F.lit("?"), "home")).alias("home"), F.when(i % 3 == 1, F.col("away")).otherwise(F.concat(F.lit("?"), "away")).alias("away"),
        (i + 1).alias("stat"), F.when(i % 2 == 0, F.col("corners_h")).alias("corners"), (F.col("ft_home") + (i % 10 == 0).cast("int")).alias("score"),
    )


TIERS = {"code": ["day", "code_home", "code_away"], "name": ["day", "home", "away"]}


@query(
    "stats_join_deduped",
    "J01 T02",
    sql(
        """SELECT c.fixture_id, CAST(COALESCE(a.v.stat, b.v.stat) AS BIGINT) AS stat, CAST(CASE WHEN a.v IS NOT NULL THEN a.v.corners ELSE b.v.corners END AS BIGINT) AS corners FROM coded c
        LEFT JOIN by_code a ON c.d = a.d AND c.ch = a.ch AND c.ca = a.ca LEFT JOIN by_name b ON c.d = b.d AND c.home = b.hn AND c.away = b.an""",
        "",
        FEED_CTE,
    ),
)
def _(t: Tables):
    """Date and codes, else date and names; a thinner copy of every feed row never replaces the full one."""
    feed = stats_feed(t)
    # thinner copies of the rows that have both optional values, with a greater number
    thin = feed.filter("corners IS NOT NULL AND score IS NOT NULL").withColumns({"corners": F.lit(None).cast(feed.schema["corners"].dataType), "score": F.lit(None).cast("int"), "stat": F.col("stat") + 5_000_000})
    base = coded(t).withColumn("day", F.to_date("kickoff")).select("fixture_id", "day", "code_home", "code_away", "home", "away")
    return jn.tiered_join(base, feed.unionByName(thin), TIERS, ["stat", "corners", "score"]).select("fixture_id", "stat", "corners")


@query(
    "tiered_stats_join",
    "J02 J03",
    sql(
        """SELECT c.fixture_id, CASE WHEN a.v IS NOT NULL THEN 'code' WHEN b.v IS NOT NULL THEN 'name' ELSE 'none' END AS match_source,
        CAST(CASE WHEN a.v IS NOT NULL AND COALESCE(a.v.score <> c.ft_home, FALSE) THEN NULL WHEN a.v IS NOT NULL THEN a.v.stat WHEN COALESCE(b.v.score <> c.ft_home, FALSE) THEN NULL ELSE b.v.stat END AS BIGINT) AS stat,
        COALESCE(COALESCE(a.v, b.v).score <> c.ft_home, FALSE) AS rejected FROM coded c
        LEFT JOIN by_code a ON c.d = a.d AND c.ch = a.ch AND c.ca = a.ca LEFT JOIN by_name b ON c.d = b.d AND c.home = b.hn AND c.away = b.an""",
        "",
        FEED_CTE,
    ),
)
def _(t: Tables):
    """The guard: joined statistics of a row whose score disagrees are dropped and the row is tagged."""
    base = coded(t).withColumn("day", F.to_date("kickoff")).select("fixture_id", "day", "code_home", "code_away", "home", "away", "ft_home")
    out = jn.tiered_join(base, stats_feed(t), TIERS, ["stat", "corners", "score"])
    rejected = F.coalesce(F.col("score") != F.col("ft_home"), F.lit(False))
    return out.select("fixture_id", "match_source", F.when(~rejected, F.col("stat")).alias("stat"), rejected.alias("rejected"))


@query(
    "odds_fill",
    "J04 J23",
    sql(
        """SELECT c.fixture_id, ROUND(COALESCE(c.odds_over, f.o), 6) AS odds_over, ROUND(COALESCE(c.odds_under, f.u), 6) AS odds_under FROM coded c
        LEFT JOIN (SELECT d, ch, ca, MAX(1.5e0 + fixture_id % 50 / 100e0) AS o, MAX(2.5e0 - fixture_id % 40 / 100e0) AS u FROM coded WHERE fixture_id % 5 <> 0 AND ch IS NOT NULL AND ca IS NOT NULL GROUP BY ALL) f
        ON c.d = f.d AND c.ch = f.ch AND c.ca = f.ca""",
        "",
        FEED_CTE,
    ),
)
def _(t: Tables):
    """A price feed joined on date and codes fills missing prices only; the best price of repeated feed rows counts."""
    base = coded(t).withColumn("day", F.to_date("kickoff"))
    keys = TIERS["code"]
    feed = base.filter((ID() % 5 != 0) & F.col("code_home").isNotNull() & F.col("code_away").isNotNull()).select(*keys, (1.5 + ID() % 50 / 100.0).alias("o"), (2.5 - ID() % 40 / 100.0).alias("u"))
    j = base.join(feed.groupBy(*keys).agg(F.max("o").alias("o"), F.max("u").alias("u")), keys, "left")
    return j.select("fixture_id", F.coalesce("odds_over", "o").alias("odds_over"), F.coalesce("odds_under", "u").alias("odds_under"))


@query(
    "unseen_teams",
    "J10",
    sql(
        f"""SELECT fixture_id, venue, CASE WHEN t1.team IS NOT NULL THEN m.home WHEN t2.code IS NOT NULL THEN t2.team END AS resolved, CASE WHEN t1.team IS NULL AND t2.code IS NULL THEN 'unknown_team' ELSE 'ok' END AS reason FROM
        (SELECT fixture_id, venue, home, {CODES_SQL} AS code, CASE WHEN fixture_id % 4 = 0 THEN 'x' || home ELSE home END AS raw FROM both_sides WHERE kickoff >= TIMESTAMP '{CUTOFF}') m
        LEFT JOIN seen t1 ON m.raw = t1.team LEFT JOIN seen t2 ON m.code = t2.code AND m.fixture_id % 8 <> 0""",
        "",
        f"""both_sides AS (SELECT fixture_id, kickoff, league, 'home' AS venue, home FROM matches UNION ALL SELECT fixture_id, kickoff, league, 'away', away FROM matches),
        seen AS (SELECT home AS team, {CODES_SQL} AS code FROM both_sides WHERE kickoff < TIMESTAMP '{CUTOFF}' GROUP BY ALL)""",
    ),
)
def _(t: Tables):
    side = lambda v: F.struct(F.lit(v).alias("venue"), F.col(v).alias("team"), F.col(f"code_{v}").alias("code"))
    both = coded(t).select("fixture_id", "kickoff", F.inline(F.array(side("home"), side("away"))))
    seen = both.filter(F.col("kickoff") < cut()).select("team", "code").distinct()
    up = both.filter(F.col("kickoff") >= cut()).select(
        "fixture_id",
        "venue",
        F.when(ID() % 4 == 0, F.concat(F.lit("x"), F.col("team"))).otherwise(F.col("team")).alias("raw"),
        F.when(ID() % 8 != 0, F.col("code")).alias("code"),
    )
    by_name = seen.select(F.col("team").alias("raw"), F.col("team").alias("n1"))
    by_code = seen.select("code", F.col("team").alias("n2"))
    j = up.join(by_name, "raw", "left").join(by_code, "code", "left").withColumn("resolved", F.coalesce("n1", "n2"))
    return j.select("fixture_id", "venue", "resolved", F.when(F.col("resolved").isNull(), "unknown_team").otherwise("ok").alias("reason"))


@query(
    "aligned_comparison",
    "J12",
    sql(
        """SELECT league, b.n AS base_rows, c.n AS cand_rows, ROUND(b.e, 6) AS base_error, ROUND(c.e, 6) AS cand_error FROM
        (SELECT league, COUNT(*) AS n, AVG(ABS(mu_home - ft_home)) AS e FROM priced p WHERE EXISTS (SELECT 1 FROM cand q WHERE q.league = p.league AND q.d = CAST(p.kickoff AS DATE) AND q.home = p.home AND q.away = p.away) GROUP BY league) b
        JOIN (SELECT league, COUNT(*) AS n, AVG(ABS(m - ft_home)) AS e FROM cand GROUP BY league) c USING (league)""",
        "priced",
        "cand AS (SELECT *, CAST(kickoff AS DATE) AS d, 0.5e0 * mu_home + 0.7e0 AS m FROM priced WHERE odds_yes IS NOT NULL)",
    ),
)
def _(t: Tables):
    """Errors of two outputs over the matches that both have; the candidate lacks those without a price."""
    keys = ["league", "day", "home", "away"]
    base = t.priced.withColumn("day", F.to_date("kickoff").cast("string"))
    cand = base.filter("odds_yes IS NOT NULL").withColumn("mu_home", 0.5 * F.col("mu_home") + 0.7)
    error = lambda df, name: df.groupBy("league").agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.avg(F.abs(F.col("mu_home") - F.col("ft_home"))).alias(f"{name}_error"))
    b, c = jn.aligned(base, cand, keys)
    return error(b, "base").join(error(c, "cand"), "league")


@query(
    "predictions_with_actuals",
    "J11",
    sql(
        """SELECT p.fixture_id, CAST(m.h AS BIGINT) AS ft_home, ROUND(p_over, 6) AS p_over FROM priced p LEFT JOIN (SELECT CAST(kickoff AS DATE) AS d, home, away, MAX(ft_home) AS h FROM scored GROUP BY ALL) m
        ON CAST(p.kickoff AS DATE) = m.d AND p.home = m.home AND p.away = m.away""",
        "priced scored",
    ),
)
def _(t: Tables):
    day = F.to_date("kickoff")
    actual = t.scored.groupBy(day.alias("d"), "home", "away").agg(F.max("ft_home").alias("ft_home"))
    preds = t.priced.select("fixture_id", day.alias("d"), "home", "away", "p_over")
    return preds.join(actual, ["d", "home", "away"], "left").select("fixture_id", "ft_home", "p_over")


@query(
    "coverage_outer",
    "J14 U04",
    sql(
        f"""SELECT COALESCE(a.home, b.away) AS team, COALESCE(a.n, 0) AS n_source, COALESCE(b.n, 0) AS n_output, b.away IS NULL AS missing FROM (SELECT home, COUNT(*) AS n FROM matches WHERE kickoff < TIMESTAMP '1996-06-01' GROUP BY home) a
        FULL OUTER JOIN (SELECT away, COUNT(*) AS n FROM matches WHERE kickoff >= TIMESTAMP '{CUTOFF}' GROUP BY away) b ON a.home = b.away""",
    ),
)
def _(t: Tables):
    a = t.matches.filter(F.col("kickoff") < F.lit("1996-06-01").cast("timestamp_ntz")).groupBy(F.col("home").alias("team")).agg(F.count(F.lit(1)).alias("a"))
    b = t.matches.filter(F.col("kickoff") >= cut()).groupBy(F.col("away").alias("team")).agg(F.count(F.lit(1)).alias("b"))
    j = a.join(b, "team", "full")
    zero = F.lit(0)
    return j.select("team", F.coalesce("a", zero).alias("n_source"), F.coalesce("b", zero).alias("n_output"), F.col("b").isNull().alias("missing"))


@query(
    "odds_tolerance_join",
    "J15",
    sql(
        """SELECT fixture_id, ROUND(price, 6) AS price, CAST(off AS BIGINT) AS day_offset FROM (SELECT m.fixture_id, p.price, o.off, ROW_NUMBER() OVER (PARTITION BY m.fixture_id ORDER BY o.prio) AS k FROM matches m CROSS JOIN (VALUES (0, 0), (1, -1), (2, 1)) o(prio, off)
        LEFT JOIN sh p ON p.home = m.home AND p.away = m.away AND p.d = CAST(m.kickoff AS DATE) + o.off WHERE p.price IS NOT NULL) WHERE k = 1
        UNION ALL SELECT fixture_id, NULL, NULL FROM matches m WHERE NOT EXISTS (SELECT 1 FROM sh p WHERE p.home = m.home AND p.away = m.away AND p.d BETWEEN CAST(m.kickoff AS DATE) - 1 AND CAST(m.kickoff AS DATE) + 1)""",
        "",
        "sh AS (SELECT home, away, CAST(kickoff AS DATE) + CAST(fixture_id % 3 - 1 AS INT) AS d, MIN(odds_over) AS price FROM matches WHERE odds_over IS NOT NULL GROUP BY ALL)",
    ),
)
def _(t: Tables):
    day = F.to_date("kickoff")
    shifted = t.matches.filter("odds_over IS NOT NULL").select(
        "home", "away", F.date_add(day, (ID() % 3 - 1).cast("int")).alias("day"), F.col("odds_over").alias("price")
    )
    left = t.matches.select("fixture_id", "home", "away", day.alias("day"))
    return jn.tolerant_price(left, shifted, ["home", "away"], "day").select("fixture_id", "price", "day_offset")


@query(
    "availability_lookup",
    "J17",
    sql(
        """SELECT s.fixture_id, s.team, ROUND(a.w, 6) AS availability FROM sides s LEFT JOIN (SELECT CAST(kickoff AS DATE) AS d, team, MIN(1 - (fixture_id % 10) / 20e0) AS w FROM sides WHERE gf >= 2 GROUP BY ALL) a
        ON a.team = s.team AND a.d = CAST(s.kickoff AS DATE)""",
        "sides",
    ),
)
def _(t: Tables):
    day = F.to_date("kickoff")
    absences = t.sides.filter("gf >= 2").groupBy(day.alias("day"), "team").agg(F.min(1 - (ID() % 10) / 20.0).alias("availability"))
    return t.sides.select("fixture_id", "team", day.alias("day")).join(absences, ["day", "team"], "left").select("fixture_id", "team", "availability")


@query(
    "external_xg_merge",
    "J20",
    sql("SELECT fixture_id, home, ROUND(CASE WHEN pos_h IS NOT NULL THEN shots_h / 10e0 END, 6) AS xg FROM matches"),
)
def _(t: Tables):
    feed = coded(t).filter("pos_h IS NOT NULL").select("fixture_id", F.concat(F.lit("FC "), F.lower("home")).alias("raw"), (F.col("shots_h") / 10.0).alias("xg"))
    mapped = normalise_team(feed, "raw", registry_of(t), "home").select("fixture_id", "home", "xg")
    return t.matches.select("fixture_id", "home").join(mapped, ["fixture_id", "home"], "left").select("fixture_id", "home", "xg")


@query(
    "alias_suggestions",
    "J22",
    sql(
        """SELECT DISTINCT replace(lower(home), 'nation', 'natoin') AS unknown, lower(home) AS canonical, ROUND(1 - 2e0 / length(home), 6) AS score, FALSE AS auto FROM matches
        UNION ALL SELECT 'zz', NULL, NULL, FALSE"""
    ),
)
def _(t: Tables):
    names = t.matches.select(F.lower("home").alias("name"))
    unknown = t.matches.select(F.replace(F.lower("home"), F.lit("nation"), F.lit("natoin")).alias("name"))
    unknown = unknown.unionByName(t.spark.createDataFrame([("zz",)], "name string"))
    return jn.alias_suggestions(unknown, names)


@query(
    "fuzzy_fixture_match",
    "J21",
    sql(
        """SELECT fixture_id AS row_id, MIN(fixture_id) OVER (PARTITION BY league, CAST(kickoff AS DATE), home, away) AS fixture_id FROM matches"""
    ),
)
def _(t: Tables):
    day = F.to_date("kickoff")
    typo = lambda c: F.replace(F.lower(c), F.lit("nation"), F.lit("natoin"))
    feed = t.matches.select(F.col("fixture_id").alias("row_id"), "league", day.alias("day"), typo("home").alias("home_raw"), typo("away").alias("away_raw"))
    fixtures = t.matches.select("fixture_id", "league", day.alias("day"), F.lower("home").alias("home"), F.lower("away").alias("away"))
    return jn.fuzzy_fixtures(feed, fixtures).select("row_id", "fixture_id")


@query(
    "round_semi_join",
    "J24 U05",
    sql("SELECT fixture_id, league FROM matches WHERE (league, CAST(kickoff AS DATE)) IN (SELECT league, MAX(CAST(kickoff AS DATE)) FROM matches GROUP BY league)"),
)
def _(t: Tables):
    day = F.to_date("kickoff")
    last = t.matches.groupBy("league").agg(F.max(day).alias("day"))
    return t.matches.withColumn("day", day).join(last, ["league", "day"], "left_semi").select("fixture_id", "league")


@query(
    "odds_alignment",
    "J25 U04",
    sql(
        """SELECT fixture_id, 'missing_odds' AS problem FROM matches WHERE odds_over IS NULL UNION ALL SELECT fixture_id + 1000000000, 'extra_odds' FROM matches WHERE pos_h IS NULL"""
    ),
)
def _(t: Tables):
    ids = t.matches.select("fixture_id")
    strays = t.matches.filter("pos_h IS NULL").select((ID() + 1_000_000_000).alias("fixture_id"))
    odds = t.matches.filter("odds_over IS NOT NULL").select("fixture_id").unionByName(strays)
    missing = ids.join(odds, "fixture_id", "left_anti").withColumn("problem", F.lit("missing_odds"))
    extra = odds.join(ids, "fixture_id", "left_anti").withColumn("problem", F.lit("extra_odds"))
    return missing.unionByName(extra)

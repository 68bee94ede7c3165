"""Queries on feed cleaning: dirty inputs are derived from the match view, so the clean value is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.config import LEAGUE_SCALARS
from kickframe.functions.cols import clamp, flag, ladder, ratio
from kickframe.functions.shots import is_header, shot_angle_deg, shot_distance_m
from kickframe.functions.text import (
    clean_id,
    clock_to_hhmm,
    fold_name,
    from_map,
    iso_utc,
    kickoff_from_parts,
    match_type,
    minutes_list,
    season_label,
    season_of,
    truthy,
)
from kickframe.operators import clean as cl
from kickframe.operators.explain import delivery_rows, explain_picks
from kickframe.operators.forms import rolling_form
from kickframe.operators.sides import to_matches
from kickframe.plans.fixtures import CUTOFF, Tables, season_start, sql
from kickframe.plans.registry import query



def ID():
    return F.col("fixture_id")


def TS_CUT():
    return F.lit(CUTOFF).cast("timestamp_ntz")


@query(
    "alias_resolution",
    "P01 P02 J23",
    sql("SELECT fixture_id, home AS home_team, away AS away_team, CAST(ft_home AS BIGINT) AS home_goals FROM matches"),
)
def _(t: Tables):
    feed = t.matches.select(
        "fixture_id",
        F.when(ID() % 3 == 0, F.col("home")).alias("HomeTeam"),
        F.when(ID() % 3 != 0, F.col("home")).alias("home_name"),
        F.col("away").alias("AWAY"),
        F.when(ID() % 2 == 0, F.col("ft_home")).alias("FTHG"),
        F.col("ft_home").alias("raw_goals"),
    )
    aliases = {
        "home_team": ["home_team", "hometeam", "home_name"],
        "away_team": ["awayteam", "away"],
        "home_goals": ["goals_home", "fthg", "raw_goals"],
    }
    assert cl.first_present(feed, ["hometeam"], ignore_case=True) == "HomeTeam"
    return cl.resolve_aliases(feed, aliases, keep=["fixture_id"])


@query(
    "kickoff_parts",
    "P03 P13",
    sql(
        """SELECT fixture_id, CAST(hour(kickoff) * 100 + 5 AS BIGINT) AS hhmm, CAST(date_trunc('day', kickoff) AS TIMESTAMP) + hour(kickoff) * INTERVAL 1 HOUR + 5 * INTERVAL 1 MINUTE AS ts FROM matches"""
    ),
)
def _(t: Tables):
    h = F.hour("kickoff")
    raw = (
        F.when(ID() % 3 == 0, F.format_string("%02d:05", h))
        .when(ID() % 3 == 1, F.format_string("%d05", h))
        .otherwise(F.format_string("%d05.0", h))
    )
    feed = t.matches.select("fixture_id", F.to_date("kickoff").alias("day"), raw.alias("clock"))
    return feed.withColumn("hhmm", clock_to_hhmm("clock")).select("fixture_id", "hhmm", kickoff_from_parts("day", "hhmm").alias("ts"))


CODES_SQL = "CAST(TRY_CAST(regexp_replace(league, '[^0-9]', '', 'g') AS BIGINT) * 100 + TRY_CAST(split_part(home, '-T', 2) AS BIGINT) AS VARCHAR)"


def code_of(team: str):
    return (F.regexp_replace("league", "[^0-9]", "").cast("bigint") * 100 + F.split(team, "-T")[1].cast("bigint")).cast("string")


def coded(t: Tables):
    return t.matches.withColumns({"code_home": code_of("home"), "code_away": code_of("away")})


@query(
    "clean_team_ids",
    "P04 P05",
    sql(
        f"SELECT fixture_id, CASE WHEN fixture_id % 41 = 0 THEN NULL ELSE {CODES_SQL} END AS code, CASE WHEN fixture_id % 41 = 0 THEN home ELSE {CODES_SQL} END AS team_id FROM matches"
    ),
)
def _(t: Tables):
    code = F.col("code_home")
    raw = F.when(ID() % 41 == 0, "nan").when(ID() % 7 == 0, F.concat(code, F.lit(".0"))).otherwise(F.concat(F.lit(" "), code, F.lit(" ")))
    feed = coded(t).select("fixture_id", "home", clean_id(raw).alias("code"))
    return feed.select("fixture_id", "code", F.coalesce("code", clean_id("home")).alias("team_id"))


@query(
    "name_folding",
    "P06",
    sql(
        """SELECT fixture_id, 'munchen ' || regexp_replace(lower(home), '[^a-z0-9]+', ' ', 'g') AS strict, 'munchen ' || regexp_replace(lower(home), '[^a-z0-9]+', ' ', 'g') AS loose FROM matches"""
    ),
)
def _(t: Tables):
    raw = F.concat(F.lit("MÜNCHEN. "), F.upper("home"))
    feed = t.matches.select("fixture_id", raw.alias("raw"), F.concat(F.lit("FC 1 "), raw).alias("prefixed"))
    return feed.select("fixture_id", fold_name("raw").alias("strict"), fold_name("prefixed", loose=True).alias("loose"))


def registry_of(t: Tables):
    return coded(t).select(F.col("code_home").alias("code"), F.col("home").alias("name")).distinct()


@query(
    "team_normalisation",
    "P07 P09",
    sql(
        """SELECT fixture_id, CASE WHEN fixture_id % 5 = 4 THEN NULL ELSE home END AS team,
        CASE fixture_id % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'exact' WHEN 2 THEN 'strict' WHEN 3 THEN 'loose' ELSE 'none' END AS team_tier FROM matches"""
    ),
)
def _(t: Tables):
    raw = (
        F.when(ID() % 5 == 0, F.concat("code_home", F.lit(".0")))
        .when(ID() % 5 == 1, F.col("home"))
        .when(ID() % 5 == 2, F.upper(F.regexp_replace("home", "[-_]", " * ")))
        .when(ID() % 5 == 3, F.concat(F.lit("FC "), F.lower("home")))
        .otherwise("unheard of")
    )
    feed = coded(t).select("fixture_id", raw.alias("raw"))
    # a name equal to its fold would also hit the strict tier; the first tier that hits wins
    return cl.normalise_team(feed, "raw", registry_of(t)).select("fixture_id", "team", "team_tier")


@query(
    "league_aliases",
    "P08 P20",
    sql(
        "SELECT fixture_id, league, CASE WHEN country = 'ASIA' AND league LIKE '%1%' THEN league || ' East' ELSE league END AS renamed FROM matches"
    ),
)
def _(t: Tables):
    raw = F.when(ID() % 3 == 0, F.lower("league")).when(ID() % 3 == 1, F.regexp_replace("league", "_", " - ")).otherwise(F.col("league"))
    feed = t.matches.select("fixture_id", "country", raw.alias("raw"))
    names = t.read("nation").select(F.col("n_name").alias("league"), fold_name("n_name").alias("_k"))
    joined = feed.withColumn("_k", fold_name("raw")).join(names, "_k", "left").drop("_k")
    renamed = F.concat("league", F.lit(" East"))
    return joined.select(
        "fixture_id", "league", F.when((F.col("country") == "ASIA") & F.col("league").contains("1"), renamed).otherwise(F.col("league")).alias("renamed")
    )


PAIRS = {
    "shots": {"split": ("sut_h", "sut_a"), "packed": "sut"},
    "sot": {"packed": "sutt"},
    "corners": {"split": ("cor_h", "cor_a")},
}


@query(
    "packed_statistics",
    "P10 P11",
    sql(
        """SELECT fixture_id, CAST(shots_h AS DOUBLE) AS shots_h, CAST(shots_a AS DOUBLE) AS shots_a, CAST(sot_h AS DOUBLE) AS sot_h, CAST(sot_a AS DOUBLE) AS sot_a,
        CASE WHEN fixture_id % 4 <> 3 THEN CAST(corners_h AS DOUBLE) END AS corners_h, CASE WHEN fixture_id % 4 <> 3 THEN CAST(corners_a AS DOUBLE) END AS corners_a FROM matches"""
    ),
)
def _(t: Tables):
    tail = F.when(ID() % 10 == 0, ",0").otherwise("")
    pair = lambda h, a: F.concat(F.col(h).cast("string"), tail, F.lit("-"), F.col(a).cast("string"), tail)
    feed = t.matches.select(
        "fixture_id",
        F.when(ID() % 4 == 0, F.col("shots_h")).alias("shots_h"),
        F.when(ID() % 4 == 0, F.col("shots_a")).alias("shots_a"),
        F.when(ID() % 4 == 1, F.col("shots_h")).cast("string").alias("sut_h"),
        F.when(ID() % 4 == 1, F.col("shots_a")).cast("string").alias("sut_a"),
        pair("shots_h", "shots_a").alias("sut"),
        pair("sot_h", "sot_a").alias("sutt"),
        F.when(ID() % 4 != 3, F.col("corners_h")).cast("string").alias("cor_h"),
        F.when(ID() % 4 != 3, F.col("corners_a")).cast("string").alias("cor_a"),
    )
    out = cl.stat_pairs(feed, PAIRS)
    return out.select("fixture_id", *[f"{s}_{x}" for s in PAIRS for x in ("h", "a")])


@query(
    "date_vote",
    "P12",
    sql("SELECT fixture_id, CASE WHEN fixture_id % 50 = 0 THEN NULL ELSE strftime(kickoff, '%Y-%m-%d') END AS day FROM matches"),
)
def _(t: Tables):
    fmt = {0: "yyyy-MM-dd", 1: "dd/MM/yyyy", 2: "dd.MM.yyyy", 3: "dd-MM-yyyy", 4: "yyyy.MM.dd", 5: "dd/MM/yy"}
    raw = F.when(ID() % 50 == 0, "")
    for k, f in fmt.items():
        raw = raw.when(ID() % 6 == k, F.date_format("kickoff", f))
    feed = t.matches.select("fixture_id", F.concat(raw, F.when(ID() % 9 == 0, " 19:00").otherwise("")).alias("raw"))
    return cl.parse_dates(feed, "raw", "day").select("fixture_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(
    "iso_timestamps",
    "P14",
    sql("SELECT fixture_id, CASE WHEN fixture_id % 20 <> 0 THEN kickoff END AS ts, strftime(kickoff, '%Y-%m-%d %H:%M') AS label FROM matches"),
)
def _(t: Tables):
    plus = F.date_format(F.col("kickoff") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(ID() % 20 == 0, "soon")
        .when(ID() % 2 == 0, F.concat(F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .otherwise(F.concat(plus, F.lit("+02:00")))
    )
    feed = t.matches.select("fixture_id", iso_utc(raw).alias("ts"), F.date_format("kickoff", "yyyy-MM-dd HH:mm").alias("label"))
    return feed


@query(
    "season_labels",
    "P15 P16",
    sql(
        """SELECT fixture_id, CAST(y AS VARCHAR) || '-' || CAST(y + 1 AS VARCHAR) AS season, disagrees FROM
        (SELECT fixture_id, year(kickoff) - CAST(month(kickoff) < 8 AS INT) AS y, CASE WHEN fixture_id % 3 <> 2 THEN month(kickoff) < 8 ELSE FALSE END AS disagrees FROM matches)"""
    ),
)
def _(t: Tables):
    y = F.year("kickoff").cast("string")
    raw = F.when(ID() % 3 == 0, F.concat(y, F.lit(".0"))).when(ID() % 3 == 1, y).otherwise(season_of("kickoff"))
    feed = t.matches.select("fixture_id", season_label(raw).alias("given"), season_of("kickoff").alias("season"))
    return feed.select("fixture_id", "season", (F.col("given") != F.col("season")).alias("disagrees"))


@query(
    "scope_counts",
    "P17 P18 Q10",
    sql(
        f"""SELECT COUNT(*) AS rows_in, COUNT(*) FILTER (kickoff >= TIMESTAMP '{CUTOFF}') AS after_past,
        COUNT(*) FILTER (kickoff >= TIMESTAMP '{CUTOFF}' AND kickoff < TIMESTAMP '2001-07-01') AS after_window,
        COUNT(*) FILTER (kickoff >= TIMESTAMP '{CUTOFF}' AND kickoff < TIMESTAMP '2001-07-01' AND country = 'ASIA') AS after_country,
        COUNT(*) FILTER (kickoff >= TIMESTAMP '{CUTOFF}' AND kickoff < TIMESTAMP '2001-07-01' AND country = 'ASIA' AND kickoff <= TIMESTAMP '{CUTOFF}' + INTERVAL 60 DAY) AS after_horizon
        FROM matches"""
    ),
)
def _(t: Tables):
    k = F.col("kickoff")
    steps = {
        "past": k >= TS_CUT(),
        "window": (k >= TS_CUT()) & (k < F.lit("2001-07-01").cast("timestamp_ntz")),
        "country": F.col("country") == "ASIA",
        "horizon": k <= TS_CUT() + F.expr("INTERVAL 60 DAYS"),
    }
    return cl.scope_chain(t.matches, steps)[1]


@query(
    "next_round",
    "P19",
    sql(
        f"""SELECT fixture_id, league, kickoff FROM matches WHERE kickoff >= TIMESTAMP '{CUTOFF}' AND kickoff <= (SELECT MIN(kickoff) FROM matches WHERE kickoff >= TIMESTAMP '{CUTOFF}') + INTERVAL 3 DAY"""
    ),
)
def _(t: Tables):
    return cl.next_round(t.matches.filter(F.col("kickoff") >= TS_CUT())).select("fixture_id", "league", "kickoff")


@query(
    "next_round_per_league",
    "P19",
    sql(
        f"""SELECT fixture_id, m.league, kickoff FROM matches m JOIN (SELECT league, MIN(kickoff) AS f FROM matches WHERE kickoff >= TIMESTAMP '{CUTOFF}' GROUP BY league) x
        ON m.league = x.league WHERE kickoff >= TIMESTAMP '{CUTOFF}' AND kickoff <= f + INTERVAL 3 DAY"""
    ),
)
def _(t: Tables):
    return cl.next_round(t.matches.filter(F.col("kickoff") >= TS_CUT()), by=["league"]).select("fixture_id", "league", "kickoff")


@query(
    "match_types",
    "P22",
    sql(
        """SELECT fixture_id, CASE fixture_id % 6 WHEN 0 THEN 'friendly' WHEN 1 THEN 'playoff' WHEN 2 THEN 'cup' WHEN 3 THEN 'league' WHEN 4 THEN 'unknown' ELSE 'league' END AS match_type FROM matches"""
    ),
)
def _(t: Tables):
    words = ["Club Friendlies", "Promotion Play-off", "Coupe", "Liga", "Final phase", " "]
    label = F.lit(words[5])
    for k, w in enumerate(words[:5]):
        label = F.when(ID() % 6 == k, w).otherwise(label)
    feed = t.matches.select("fixture_id", "league", label.alias("stage"), F.lit(None).cast("string").alias("competition_type"))
    return feed.select("fixture_id", match_type(["competition_type", "stage"]).alias("match_type"))


@query(
    "quality_flags",
    "P23 P24",
    sql(
        """SELECT fixture_id, f AS quality_flags, CAST(crit AS BIGINT) AS quality_critical, CASE WHEN crit = 1 THEN 'BAD' WHEN f <> '' THEN 'WARN' ELSE 'OK' END AS quality_status FROM
        (SELECT fixture_id, concat_ws('|', CASE WHEN press_n_h <= 0 OR press_n_a <= 0 THEN 'press_stats_missing' WHEN LEAST(press_n_h, press_n_a) < 3 THEN 'press_stats_low' END,
          CASE WHEN xg_n_h <= 0 OR xg_n_a <= 0 THEN 'xg_stats_missing' WHEN LEAST(xg_n_h, xg_n_a) < 3 THEN 'xg_stats_low' END,
          CASE WHEN neff_h < 3 OR neff_a < 3 THEN 'elo_evidence_low' END, CASE WHEN odds_over IS NULL OR odds_under IS NULL THEN 'odds_ou_missing' END,
          CASE WHEN odds_yes IS NULL OR odds_no IS NULL THEN 'odds_btts_missing' END) AS f,
          CASE WHEN press_n_h <= 0 OR press_n_a <= 0 OR xg_n_h <= 0 OR xg_n_a <= 0 OR COALESCE(neff_h < 3, FALSE) OR neff_a < 3 THEN 1 ELSE 0 END AS crit FROM priced)""",
        "priced",
    ),
)
def _(t: Tables):
    low = lambda a, b: (F.col(a) > 0) & (F.col(b) > 0) & (F.least(a, b) < 3)
    none = lambda a, b: (F.col(a) <= 0) | (F.col(b) <= 0)
    flags = [
        (none("press_n_h", "press_n_a"), "press_stats_missing"),
        (low("press_n_h", "press_n_a"), "press_stats_low"),
        (none("xg_n_h", "xg_n_a"), "xg_stats_missing"),
        (low("xg_n_h", "xg_n_a"), "xg_stats_low"),
        ((F.col("neff_h") < 3) | (F.col("neff_a") < 3), "elo_evidence_low"),
        (F.col("odds_over").isNull() | F.col("odds_under").isNull(), "odds_ou_missing"),
        (F.col("odds_yes").isNull() | F.col("odds_no").isNull(), "odds_btts_missing"),
    ]
    out = cl.quality_status(t.priced, flags, ["press_stats_missing", "xg_stats_missing", "elo_evidence_low"])
    return out.select("fixture_id", "quality_flags", "quality_critical", "quality_status")


@query(
    "outcome_labels",
    "P25 P26",
    sql(
        """SELECT fixture_id, CASE WHEN ft_home + ft_away > 2.5 THEN 'OVER' ELSE 'UNDER' END AS ou, CASE WHEN ft_home > 0 AND ft_away > 0 THEN 'YES' ELSE 'NO' END AS btts,
        CASE WHEN odds_over IS NULL THEN 'missing' WHEN odds_over < 1.7 THEN '<1.70' WHEN odds_over < 2.1 THEN '1.70-2.09' WHEN odds_over < 2.6 THEN '2.10-2.59' ELSE '2.60+' END AS odds_bucket,
        CASE WHEN p_over < 0.52 THEN '<0.52' WHEN p_over < 0.56 THEN '0.52-0.55' WHEN p_over < 0.6 THEN '0.56-0.59' WHEN p_over < 0.65 THEN '0.60-0.64' ELSE '0.65+' END AS prob_bucket FROM priced""",
        "priced",
    ),
)
def _(t: Tables):
    from kickframe.operators.settle import ODDS_STEPS, PROB_STEPS

    return t.priced.select(
        "fixture_id",
        F.when(F.col("ft_home") + F.col("ft_away") > 2.5, "OVER").otherwise("UNDER").alias("ou"),
        F.when((F.col("ft_home") > 0) & (F.col("ft_away") > 0), "YES").otherwise("NO").alias("btts"),
        ladder("odds_over", ODDS_STEPS, "2.60+", "missing").alias("odds_bucket"),
        ladder("p_over", PROB_STEPS, "0.65+", "missing").alias("prob_bucket"),
    )


FH = "(PARTITION BY home ORDER BY kickoff, away, fixture_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
FA = "(PARTITION BY away ORDER BY kickoff, home, fixture_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query(
    "attack_defence_indices",
    "P29 P30",
    sql(
        """SELECT fixture_id, ROUND((hs + 0.5) / (hsh + 1), 6) AS shot_quality_h, ROUND((hg + 0.5) / (hs + 1), 6) AS finish_rate_h, ROUND(hg / NULLIF(lh, 0), 6) AS attack_h,
        ROUND(hc / NULLIF(la, 0), 6) AS defence_h, ROUND(ag / NULLIF(la, 0), 6) AS attack_a, ROUND(ac / NULLIF(lh, 0), 6) AS defence_a,
        ROUND(hg / NULLIF(lh, 0) * ac / NULLIF(lh, 0), 6) AS expected_h, ROUND(ag / NULLIF(la, 0) * hc / NULLIF(la, 0), 6) AS expected_a FROM f JOIN lg USING (league)""",
        "",
        f"""lg AS (SELECT league, AVG(ft_home) AS lh, AVG(ft_away) AS la FROM matches GROUP BY league),
        f AS (SELECT fixture_id, league, AVG(ft_home) OVER {FH} AS hg, AVG(ft_away) OVER {FH} AS hc, AVG(shots_h) OVER {FH} AS hsh, AVG(sot_h) OVER {FH} AS hs,
              AVG(ft_away) OVER {FA} AS ag, AVG(ft_home) OVER {FA} AS ac FROM matches)""",
    ),
)
def _(t: Tables):
    form = rolling_form(t.sides, ["gf", "ga", "shots_for", "sot_for"], windows=(5,))
    m = to_matches(form, ["gf_l5", "ga_l5", "shots_for_l5", "sot_for_l5"])
    lg = t.matches.groupBy("league").agg(F.avg("ft_home").alias("lh"), F.avg("ft_away").alias("la"))
    df = t.matches.select("fixture_id", "league").join(m, "fixture_id").join(lg, "league")
    ah, dh = ratio("gf_l5_home", "lh"), ratio("ga_l5_home", "la")
    aa, da = ratio("gf_l5_away", "la"), ratio("ga_l5_away", "lh")
    return df.select(
        "fixture_id",
        ((F.col("sot_for_l5_home") + 0.5) / (F.col("shots_for_l5_home") + 1)).alias("shot_quality_h"),
        ((F.col("gf_l5_home") + 0.5) / (F.col("sot_for_l5_home") + 1)).alias("finish_rate_h"),
        ah.alias("attack_h"), dh.alias("defence_h"), aa.alias("attack_a"), da.alias("defence_a"),
        (ah * da).alias("expected_h"), (aa * dh).alias("expected_a"),
    )


@query(
    "league_scalars",
    "P32 M11",
    sql(
        """SELECT fixture_id, ROUND(LEAST(GREATEST(CASE league WHEN 'NATION_1' THEN 1.7e0 WHEN 'NATION_2' THEN 9e0 ELSE 1e0 END, 0.5e0), 2e0), 6) AS goal_multiplier,
        ROUND(GREATEST(0.01e0, mu_home * LEAST(GREATEST(CASE league WHEN 'NATION_1' THEN 1.7e0 WHEN 'NATION_2' THEN 9e0 ELSE 1e0 END, 0.5e0), 2e0)), 6) AS mu_home_scaled FROM priced""",
        "priced",
    ),
)
def _(t: Tables):
    lo, hi = LEAGUE_SCALARS["goal_multiplier"]["bounds"]
    mult = clamp(from_map(F.col("league"), {"NATION_1": 1.7, "NATION_2": 9.0}, LEAGUE_SCALARS["goal_multiplier"]["default"]), lo, hi)
    return t.priced.select("fixture_id", mult.alias("goal_multiplier"), F.greatest(F.lit(0.01), F.col("mu_home") * mult).alias("mu_home_scaled"))


SHOT_SQL = """shots AS (SELECT l_orderkey * 10 + l_linenumber AS shot_id, 0.6e0 + (l_partkey % 40) / 100e0 AS x, 0.1e0 + (l_suppkey % 80) / 100e0 AS y,
  CASE WHEN l_linenumber % 3 = 0 THEN 'Header' ELSE 'RightFoot' END AS shot_type FROM lineitem)"""


def shots(t: Tables):
    return t.read("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("shot_id"),
        F.col("l_orderkey").alias("fixture_id"),
        (0.6 + (F.col("l_partkey") % 40) / 100.0).alias("x"),
        (0.1 + (F.col("l_suppkey") % 80) / 100.0).alias("y"),
        F.when(F.col("l_linenumber") % 3 == 0, "Header").otherwise("RightFoot").alias("shot_type"),
        F.when(F.col("l_returnflag") == "A", "Goal").otherwise("Saved").alias("result"),
        F.when(F.col("l_linestatus") == "O", "h").otherwise("a").alias("h_a"),
        F.when(F.col("l_linenumber") % 4 == 2, "FromCorner").otherwise("OpenPlay").alias("situation"),
        F.col("l_quantity").cast("double").alias("qty"),
    )


@query(
    "shot_geometry",
    "P33",
    "WITH "
    + SHOT_SQL
    + """ SELECT shot_id, ROUND(sqrt(pow((1 - x) * 105, 2) + pow((y - 0.5) * 68, 2)), 6) AS distance_m,
    ROUND(degrees(abs(atan2(3.66e0 - (y - 0.5) * 68, (1 - x) * 105) - atan2(-3.66e0 - (y - 0.5) * 68, (1 - x) * 105))), 6) AS angle_deg,
    CASE WHEN shot_type = 'Header' THEN CAST(1 AS BIGINT) ELSE 0 END AS header FROM shots""",
)
def _(t: Tables):
    return shots(t).select(
        "shot_id", shot_distance_m("x", "y").alias("distance_m"), shot_angle_deg("x", "y").alias("angle_deg"), is_header("shot_type").alias("header")
    )


@query(
    "truthy_flags",
    "P34",
    "SELECT event_id, CAST(CASE WHEN event_id % 5 IN (0, 2, 3) THEN 1 ELSE 0 END AS BIGINT) AS flag FROM events",
)
def _(t: Tables):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, "Yes").when(i % 5 == 1, "none").when(i % 5 == 2, " TRUE ").when(i % 5 == 3, "2.5").otherwise("odd")
    return t.read("events").select("event_id", truthy(raw).alias("flag"))


PCT = "CAST(CAST(round({p} * 100 + 1e-9) AS INT) AS VARCHAR) || '%'"
NEFF_LBL = "CASE WHEN {n} IS NULL THEN 'unknown comparable history' WHEN {n} < 4 THEN 'thin comparable history' WHEN {n} < 7 THEN 'some comparable history' WHEN {n} < 10 THEN 'solid comparable history' ELSE 'strong comparable history' END"


@query(
    "pick_explanations",
    "P35",
    sql(
        f"""SELECT fixture_id, home || ' vs ' || away || ' | Over 2.5 goals' AS title,
        'Model ' || {PCT.format(p='p_over')} || ' vs price ' || COALESCE({PCT.format(p='(1e0 / odds_over)')}, '-') || ' | Expected goals ' || printf('%.1f', mu_total + 1e-9) || ' | ' || {NEFF_LBL.format(n='neff_h')} || ' | Flags: ' ||
        CASE WHEN sterile = 1 AND assassin = 1 THEN 'sterile, assassin' WHEN sterile = 1 THEN 'sterile' WHEN assassin = 1 THEN 'assassin' ELSE 'none' END AS numbers,
        CASE WHEN odds_over IS NULL THEN 'an almost fair price' WHEN p_over * odds_over - 1 < 0.02 THEN 'an almost fair price' WHEN p_over * odds_over - 1 < 0.04 THEN 'a small edge'
             WHEN p_over * odds_over - 1 < 0.08 THEN 'a solid edge' ELSE 'a strong edge' END AS edge FROM priced""",
        "priced",
    ),
)
def _(t: Tables):
    picks = t.priced.select(
        "fixture_id", "home", "away", F.lit("OU25_OVER").alias("market"), F.col("odds_over").alias("odds"), F.col("p_over").alias("p_model"),
        "mu_total", F.col("neff_h").alias("neff_min"), "sterile", "assassin",
    )
    return explain_picks(picks).select("fixture_id", "title", "numbers", "edge")


@query(
    "delivery_rows",
    "P36",
    sql(
        """SELECT fixture_id, ou_lbl, btts_lbl, ROUND(ou_conf, 6) AS ou_conf_pct, ROUND(ou_ev, 6) AS ou_ev_pct, ROUND(bt_conf, 6) AS btts_conf_pct, ROUND(bt_ev, 6) AS btts_ev_pct FROM
        (SELECT fixture_id, CASE WHEN p_over >= p_under THEN 'OVER' ELSE 'UNDER' END AS ou_lbl, CASE WHEN p_btts >= 0.5 THEN 'YES' ELSE 'NO' END AS btts_lbl,
         100 * GREATEST(p_over, p_under) AS ou_conf, 100 * CASE WHEN p_over >= p_under THEN p_over * odds_over - 1 ELSE p_under * odds_under - 1 END AS ou_ev,
         100 * CASE WHEN p_btts >= 0.5 THEN p_btts ELSE 1 - p_btts END AS bt_conf, 100 * CASE WHEN p_btts >= 0.5 THEN p_btts * odds_yes - 1 ELSE (1 - p_btts) * odds_no - 1 END AS bt_ev FROM priced)
        WHERE (ou_ev > 5 AND ou_conf >= 55) OR (bt_ev > 5 AND bt_conf >= 55)""",
        "priced",
    ),
)
def _(t: Tables):
    return delivery_rows(t.priced, min_ev_pct=5.0, min_conf_pct=55.0)


@query(
    "contract_check",
    "P37",
    "SELECT 'l_orderkey' AS \"column\", CAST(MIN(l_orderkey) AS VARCHAR) AS value, MIN(l_orderkey) = MAX(l_orderkey) AS constant FROM lineitem "
    "UNION ALL SELECT 'run_stamp', '2001-01-01', TRUE",
)
def _(t: Tables):
    df = t.read("lineitem").select("l_orderkey", F.lit("2001-01-01").alias("run_stamp"))
    cl.require_columns(df, ["l_orderkey", "run_stamp"], "lines")
    return cl.constant_columns(df, ["l_orderkey", "run_stamp"])


@query(
    "feature_screen",
    "P38 P39",
    sql(
        """SELECT fixture_id, CAST(corners_h AS BIGINT) AS corners_h, CAST(corners_a AS BIGINT) AS corners_a FROM matches WHERE corners_h IS NOT NULL AND corners_a IS NOT NULL"""
    ),
)
def _(t: Tables):
    """All rows and numeric columns: a column with many gaps goes (possession), a row with a gap in a column that stays goes (corners)."""
    cols = cl.feature_columns(t.matches, ban_exact=["ft_home", "ft_away"], ban_tokens=["odds", "shots", "sot"])
    picked = t.matches.select(*cols)
    few = t.read("orders").count() // 20  # up to 5 percent missing per column
    return cl.drop_sparse(picked, few)


@query(
    "minute_lists",
    "P34 A12 X04",
    "SELECT l_orderkey AS fixture_id, COUNT(*) AS n, CAST(SUM(1 + (l_orderkey * 7 + l_linenumber * 13) % 90) AS BIGINT) AS total FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1",
)
def _(t: Tables):
    goals = goal_lists(t)
    m = minutes_list("goalsh")
    return goals.filter("goalsh IS NOT NULL").select("fixture_id", F.size(m).alias("n"), F.aggregate(m, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def goal_lists(t: Tables):
    """Goal-minute text per fixture, stoppage time written as ``m+2`` on some lines."""
    minute = 1 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 90
    token = F.concat(F.when(F.col("l_linenumber") % 4 == 1, "H").otherwise(""), minute.cast("string"), F.when(F.col("l_linenumber") % 5 == 0, "+2").otherwise(""))
    lines = t.read("lineitem").filter(F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_returnflag", token.alias("tok"))
    return lines.groupBy(F.col("l_orderkey").alias("fixture_id")).agg(
        F.nullif(F.array_join(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("tok"))), ","), F.lit("")).alias("goalsh"),
        F.nullif(F.array_join(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("tok"))), ";"), F.lit("")).alias("goalsa"),
    )

"""Queries on tops, sets, candidates, picks, settlement and round evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.functions.cols import unix
from kickframe.functions.text import from_map
from kickframe.operators import clean as cl
from kickframe.operators import picks as pk
from kickframe.operators import settle as st
from kickframe.operators import summaries as sm
from kickframe.operators import tops as tp
from kickframe.operators.ordered import ordinal
from kickframe.plans.fixtures import Tables, sql
from kickframe.plans.markets import VAL_CTE, valued
from kickframe.plans.registry import query
from kickframe.plans.summaries import BETS_SQL, bets
from kickframe.session import cut_lineage, stored


def ID():
    return F.col("fixture_id")


# ---------------------------------------------------------------- sorts, dedupes, top-k


@query("stable_order", "T01 T16", sql("SELECT fixture_id, kickoff, home, away FROM matches ORDER BY kickoff, home, away, fixture_id"))
def _(t: Tables):
    return t.matches.select("fixture_id", "kickoff", "home", "away").orderBy("kickoff", "home", "away", "fixture_id")


@query(
    "dedupe_most_odds",
    "T03 T04 U02",
    sql(
        """SELECT fixture_id, ROUND(odds_over, 6) AS odds_over, ROUND(CASE WHEN odds_over IS NULL THEN NULL ELSE odds_under END, 6) AS odds_under FROM matches"""
    ),
)
def _(t: Tables):
    full = t.matches.select("fixture_id", "odds_over", "odds_under", F.lit(2).alias("seq"))
    thin = full.withColumns({"odds_under": F.lit(None).cast("double"), "seq": F.lit(1)})
    return tp.keep_best(full.unionByName(thin), ["fixture_id"], ["odds_over", "odds_under"], F.col("seq")).select("fixture_id", "odds_over", "odds_under")


@query("last_payload_wins", "T05 S12", sql("SELECT fixture_id, 'v' || CAST(fixture_id % 3 AS VARCHAR) AS payload FROM matches"))
def _(t: Tables):
    versions = t.matches.select("fixture_id", F.explode(F.sequence(F.lit(0), (ID() % 3).cast("int"))).alias("arrival"))
    versions = versions.withColumn("payload", F.concat(F.lit("v"), F.col("arrival").cast("string")))
    return tp.keep_last(versions, ["fixture_id"], F.col("arrival")).select("fixture_id", "payload")


@query(
    "first_occurrence",
    "T04 J19",
    sql("SELECT CAST(kickoff AS DATE)::VARCHAR AS day, home, MIN(fixture_id) AS fixture_id FROM matches GROUP BY ALL"),
)
def _(t: Tables):
    day = F.date_format("kickoff", "yyyy-MM-dd")
    return tp.keep_first(t.matches.select(day.alias("day"), "home", "fixture_id"), ["day", "home"], F.col("fixture_id"))


@query(
    "last_match_days",
    "T09",
    sql("SELECT fixture_id, home FROM matches WHERE CAST(kickoff AS DATE) IN (SELECT DISTINCT CAST(kickoff AS DATE) AS d FROM matches ORDER BY d DESC LIMIT 5)"),
)
def _(t: Tables):
    return tp.last_n_dates(t.matches, "kickoff", 5).select("fixture_id", "home")


@query(
    "first_upcoming",
    "T10",
    sql(
        """SELECT fixture_id, kickoff FROM matches WHERE kickoff >= TIMESTAMP '2001-01-01' AND kickoff <= (SELECT MIN(kickoff) FROM matches WHERE kickoff >= TIMESTAMP '2001-01-01') + INTERVAL 3 DAY
        ORDER BY kickoff, home, away, fixture_id LIMIT 20"""
    ),
)
def _(t: Tables):
    up = t.matches.filter(F.col("kickoff") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    return tp.first_n(cl.next_round(up, days=3), ["kickoff", "home", "away", "fixture_id"], 20).select("fixture_id", "kickoff")


@query("frequent_teams", "T15", sql("SELECT home, COUNT(*) AS n FROM matches GROUP BY home ORDER BY n DESC, home LIMIT 15"))
def _(t: Tables):
    return tp.common_values(t.matches, "home", 15)


@query(
    "best_market_by_ev",
    "T08 T11",
    sql(
        """SELECT fixture_id, market, ROUND(ev, 6) AS ev FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fixture_id ORDER BY round(ev, 9) DESC, market) AS k FROM (SELECT *, p * odds - 1 AS ev FROM bets) WHERE ev IS NOT NULL) WHERE k = 1""",
        "priced",
        BETS_SQL,
    ),
)
def _(t: Tables):
    b = bets(t).filter("ev IS NOT NULL")
    return b.groupBy("fixture_id").agg(F.min_by(F.struct("market", "ev"), F.struct(-F.round("ev", 9), F.col("market"))).alias("b")).select("fixture_id", "b.*")


@query(
    "best_per_family",
    "T12 J18",
    sql(
        """SELECT fixture_id, MIN(o) FILTER (fam = '1X2') AS best_1x2, MIN(o) FILTER (fam = 'OU') AS best_ou, MIN(o) FILTER (fam = 'TG') AS best_tg, ROUND(MAX(prob) FILTER (fam = '1X2'), 6) AS fav_prob FROM
        (SELECT *, market || ' ' || outcome AS o, ROW_NUMBER() OVER (PARTITION BY fixture_id, fam ORDER BY round(prob, 9) DESC, market || ' ' || outcome) AS k FROM (SELECT *, CASE WHEN market LIKE 'OU%' THEN 'OU' WHEN market LIKE 'TG%' THEN 'TG' ELSE market END AS fam FROM book)) WHERE k = 1 GROUP BY fixture_id""",
        "priced",
        VAL_CTE,
    ),
)
def _(t: Tables):
    from kickframe.plans.markets import book

    b = book(t).withColumn("o", F.concat_ws(" ", "market", "outcome"))
    best = lambda cond: F.min_by("o", F.when(cond, F.struct(-F.round("prob", 9), F.col("o"))))
    m = F.col("market")
    return b.groupBy("fixture_id").agg(
        best(m == "1X2").alias("best_1x2"), best(m.startswith("OU")).alias("best_ou"), best(m.startswith("TG")).alias("best_tg"),
        F.max(F.when(m == "1X2", F.col("prob"))).alias("fav_prob"),
    )


@query(
    "set_operations",
    "U01 U03 U04 S13",
    sql(
        """SELECT 'both' AS kind, team FROM (SELECT home AS team FROM matches WHERE ft_home >= 4 INTERSECT SELECT away FROM matches WHERE ft_away >= 4)
        UNION ALL SELECT 'home_only', team FROM (SELECT home AS team FROM matches WHERE ft_home >= 4 EXCEPT SELECT away FROM matches WHERE ft_away >= 4)
        UNION ALL SELECT 'any', team FROM (SELECT home AS team FROM matches WHERE ft_home >= 4 UNION SELECT away FROM matches WHERE ft_away >= 4)"""
    ),
)
def _(t: Tables):
    h = t.matches.filter("ft_home >= 4").select(F.col("home").alias("team"), F.lit(1).alias("extra"))
    a = t.matches.filter("ft_away >= 4").select(F.col("away").alias("team"))
    either = h.unionByName(a, allowMissingColumns=True).select("team").distinct()
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "team")
    hs = h.select("team")
    return tag(hs.intersect(a), "both").unionByName(tag(hs.subtract(a), "home_only")).unionByName(tag(either, "any"))


# ---------------------------------------------------------------- candidates and picks


def rules() -> pk.PickRules:
    return pk.PickRules(
        evidence_primary={"NATION_1": (4.0, 2.0, 2.0), "NATION_2": (6.0, 3.0, 3.0), "NATION_3": (3.0, 1.0, 1.0)},
        raw_score_leagues=("NATION_2",),
        blocked={"NATION_2": ["BTTS_NO"]},
        tier_bonus={("NATION_2", "fallback"): 0.06},
        market_bonus={("NATION_1", "OU25_OVER"): -0.18, ("NATION_3", "BTTS_NO"): 0.18},
        calibration={"NATION_5": (0.58, 0.55)},
    )


CAND_SQL = """c0 AS (SELECT *, CASE WHEN neff_h IS NOT NULL THEN LEAST(neff_h, neff_a) END AS neff_min, LEAST(press_n_h, press_n_a) AS press_n_min, LEAST(xg_n_h, xg_n_a) AS xg_n_min,
    CAST(CAST(mu_total < 2.3 AS INT) + CAST(mu_home < 1.2 AND mu_away < 1.2 AS INT) + CAST(sterile > 0 AS INT) + CAST(p_under > 0.52 AS INT) >= 2 AS BIGINT) AS low_scoring,
    CASE league WHEN 'NATION_1' THEN 4 WHEN 'NATION_2' THEN 6 WHEN 'NATION_3' THEN 3 ELSE 1 END AS g1, CASE league WHEN 'NATION_1' THEN 2 WHEN 'NATION_2' THEN 3 ELSE 1 END AS g2 FROM priced),
  c1 AS (SELECT *, CASE WHEN COALESCE(neff_min >= g1, FALSE) AND press_n_min >= g2 AND xg_n_min >= g2 THEN 'primary' ELSE 'fallback' END AS gate_tier FROM c0),
  c2 AS (SELECT c1.*, market, market_rank, CASE market WHEN 'OU25_OVER' THEN p_over WHEN 'OU25_UNDER' THEN p_under WHEN 'BTTS_YES' THEN p_btts ELSE 1 - p_btts END AS p_model,
    CASE market WHEN 'OU25_OVER' THEN odds_over WHEN 'OU25_UNDER' THEN odds_under WHEN 'BTTS_YES' THEN odds_yes ELSE odds_no END AS odds FROM c1, (VALUES ('OU25_OVER', 0), ('OU25_UNDER', 1), ('BTTS_YES', 2), ('BTTS_NO', 3)) v(market, market_rank)),
  c3 AS (SELECT *, list_sort(list_filter([CASE WHEN mu_total < 1.6 THEN 'G2_FAIL_LOW_MU_TOTAL' END, CASE WHEN mu_total > 3.4 THEN 'G2_FAIL_HIGH_MU_TOTAL' END,
      CASE WHEN gate_tier = 'fallback' AND NOT COALESCE(neff_min >= 1, FALSE) THEN 'G3_FAIL_LOW_NEFF' END, CASE WHEN gate_tier = 'fallback' AND press_n_min < 1 THEN 'G3_FAIL_LOW_PRESS_EVIDENCE' END,
      CASE WHEN gate_tier = 'fallback' AND xg_n_min < 1 THEN 'G3_FAIL_LOW_XG_EVIDENCE' END, CASE WHEN league = 'NATION_2' AND market = 'BTTS_NO' THEN 'G7_FAIL_LEAGUE_MARKET_BLOCKED' END,
      CASE WHEN league = 'NATION_5' AND ((market = 'OU25_OVER' AND p_model < 0.58) OR (market = 'BTTS_YES' AND p_model < 0.55) OR (market = 'BTTS_NO' AND 1 - p_model > 0.55)) THEN 'G6_FAIL_CALIB_' || market END,
      CASE WHEN odds <= 1.7 THEN 'G1_FAIL_LOW_ODDS' END, CASE WHEN NOT p_model > 0.52 THEN 'G5_FAIL_LOW_MODEL_PROB' END], lambda x: x IS NOT NULL)) AS why FROM c2),
  cand AS (SELECT *, len(why) = 0 AS eligible, array_to_string(why, '|') AS reasons, p_model * odds - 1 AS ev,
    round(GREATEST(p_model - 0.5, 0) * 2 + 0.01 * ln(1 + GREATEST(neff_min, 0)) + 0.005 * (press_n_min + xg_n_min) + CASE WHEN odds > 1.7 THEN 0.08 ELSE 0 END + CASE WHEN market = 'OU25_UNDER' AND low_scoring = 1 THEN 0.04 ELSE 0 END
      + CASE WHEN league = 'NATION_1' AND market = 'OU25_OVER' THEN -0.18 WHEN league = 'NATION_3' AND market = 'BTTS_NO' THEN 0.18 ELSE 0 END + CASE WHEN league = 'NATION_2' AND gate_tier = 'fallback' THEN 0.06 ELSE 0 END, 10) AS score FROM c3)"""


@query(
    "pick_candidates",
    "M25 M26 M27 M28",
    sql(
        "SELECT fixture_id, market, gate_tier, low_scoring, ROUND(p_model, 6) AS p_model, ROUND(ev, 6) AS ev, eligible, reasons, ROUND(CASE WHEN neff_min IS NOT NULL THEN score END, 6) AS score FROM cand",
        "priced",
        CAND_SQL,
    ),
)
def _(t: Tables):
    rows = pk.candidates(t.priced, rules(), ["fixture_id", "neff_h", "neff_a"])
    score = F.when(F.col("neff_h").isNotNull(), F.col("score"))
    return rows.select("fixture_id", "market", "gate_tier", "low_scoring", "p_model", "ev", "eligible", "reasons", score.alias("score"))


PICK_SQL = (
    CAND_SQL
    + """,
  wk AS (SELECT *, CAST(date_trunc('week', kickoff) AS TIMESTAMP) AS week, CASE WHEN gate_tier = 'primary' THEN 0 ELSE 1 END AS gr, CASE WHEN league = 'NATION_2' THEN 0 WHEN gate_tier = 'primary' THEN 0 ELSE 1 END AS lead FROM cand WHERE eligible),
  best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fixture_id ORDER BY lead, score DESC, round(p_model, 10) DESC, gr, neff_min DESC, market_rank) AS k FROM wk) WHERE k = 1),
  rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY league, week ORDER BY lead, score DESC, round(p_model, 10) DESC, gr, neff_min DESC, market_rank, market, fixture_id) AS pick_rank,
     COUNT(*) FILTER (gr = 0) OVER (PARTITION BY league, week) AS n_first FROM best),
  picks AS (SELECT *, GREATEST(0, p_model - 0.5) * LEAST(neff_min / 10, 1) * LEAST(press_n_min / 5, 1) * LEAST(xg_n_min / 5, 1) * CASE WHEN sterile > 0 OR assassin > 0 THEN 0.85 ELSE 1 END AS confidence FROM rk
     WHERE pick_rank <= 5 AND (league = 'NATION_2' OR gr = 0 OR n_first < 4))"""
)


def picks(t: Tables):
    week = F.date_trunc("week", F.col("kickoff")).cast("timestamp_ntz")
    keep = ["fixture_id", "kickoff", "week", "league", "home", "away", "ft_home", "ft_away", "sterile", "assassin", "slow_start", "late_goal"]
    return pk.select_picks(t.priced.withColumn("week", week), rules(), ["league", "week"], keep)


@query(
    "picks",
    "T06 T07 M29",
    sql(
        """SELECT fixture_id, league, market, gate_tier, pick_rank, ROUND(score, 6) AS score, ROUND(confidence, 6) AS confidence, CASE WHEN round(confidence, 10) < 0.05 THEN 'T1' WHEN round(confidence, 10) < 0.09 THEN 'T2' WHEN round(confidence, 10) < 0.13 THEN 'T3' ELSE 'T4' END AS stake_tier,
        ROUND(p_model - 1 / odds, 6) AS value_margin, concat_ws('|', CASE WHEN sterile > 0 THEN 'STERILE' END, CASE WHEN assassin > 0 THEN 'ASSASSIN' END, CASE WHEN slow_start > 0 THEN 'SLOW_START' END, CASE WHEN late_goal > 0 THEN 'LATE_GOALS' END) AS risk_flags FROM picks""",
        "priced",
        PICK_SQL,
    ),
)
def _(t: Tables):
    return picks(t).select("fixture_id", "league", "market", "gate_tier", "pick_rank", "score", "confidence", "stake_tier", "value_margin", "risk_flags")


@query(
    "full_market_picks",
    "M30 T08",
    sql(
        """SELECT fixture_id, market, ROUND(p, 6) AS p_model, ROUND(o, 6) AS odds, ROUND(ev, 6) AS ev FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fixture_id ORDER BY round(ev, 10) DESC, r) AS k FROM
        (SELECT *, p * o - 1 AS ev FROM (SELECT *, UNNEST([{'market': '1X2_HOME', 'r': 0, 'p': mu_home / (mu_total + 0.6), 'o': odds_yes + 0.4}, {'market': '1X2_AWAY', 'r': 1, 'p': mu_away / (mu_total + 0.6), 'o': odds_no + 0.4}, {'market': 'OU25_OVER', 'r': 2, 'p': p_over, 'o': odds_over}, {'market': 'OU25_UNDER', 'r': 3, 'p': p_under, 'o': odds_under}], recursive := true) FROM
          (SELECT * FROM priced WHERE mu_total BETWEEN 1.6 AND 3.4 AND LEAST(neff_h, neff_a) >= 3 AND press_n_h >= 2 AND press_n_a >= 2 AND xg_n_h >= 2 AND xg_n_a >= 2)))
        WHERE CASE WHEN market LIKE '1X2%' THEN odds_yes + 0.4 > 1.01 AND odds_no + 0.4 > 1.01 ELSE odds_over > 1.01 AND odds_under > 1.01 END AND NOT (sterile > 0 AND market = 'OU25_OVER') AND ev >= CASE WHEN assassin > 0 THEN 0.07 ELSE 0.05 END) WHERE k = 1""",
        "priced",
    ),
)
def _(t: Tables):
    den = F.col("mu_total") + 0.6
    markets = {
        "1X2_HOME": (F.col("mu_home") / den, F.col("odds_yes") + 0.4, "1X2"),
        "1X2_AWAY": (F.col("mu_away") / den, F.col("odds_no") + 0.4, "1X2"),
        "OU25_OVER": (F.col("p_over"), F.col("odds_over"), "OU25"),
        "OU25_UNDER": (F.col("p_under"), F.col("odds_under"), "OU25"),
    }
    limits = {"mu": (1.6, 3.4), "neff": 3.0, "press": 2.0, "xg": 2.0, "odds_min": 1.01, "ev": 0.05, "ev_assassin": 0.07}
    return pk.full_market_picks(t.priced, markets, limits)


@query(
    "rule_strategies",
    "M31 X01 J18",
    sql(
        """SELECT 'favourite' AS strategy, fixture_id, market, outcome FROM v WHERE market = '1X2' AND CASE outcome WHEN 'H' THEN eh - ea WHEN 'A' THEN ea - eh END >= 40 AND prob >= 0.52 AND edge >= -0.01 + 0.02 AND odds >= 1.6
        UNION ALL SELECT 'totals', fixture_id, market, outcome FROM v WHERE market = 'OU 2.5' AND prob >= 0.57 AND edge >= 0.01 AND odds >= 1.6 UNION ALL SELECT 'interval', fixture_id, market, outcome FROM v WHERE market = 'TG Interval' AND prob >= 0.4 AND edge >= 0.03 AND odds >= 1.6
        UNION ALL SELECT 'underdog', fixture_id, market, outcome FROM v JOIN (SELECT fixture_id, MAX(prob) AS fav FROM v WHERE market = '1X2' GROUP BY fixture_id) f USING (fixture_id) WHERE market = 'DC' AND fav <= 0.6 AND edge >= 0.01 AND odds >= 1.4""",
        "priced",
        VAL_CTE
        + ", v AS (SELECT *, round(prob - CASE market WHEN 'DC' THEN 0.3 ELSE 0.05 END * (outcome <> 'D')::INT + (fixture_id % 20) / 100e0, 9) AS e2, 1400e0 + fixture_id * 37 % 200 AS eh, 1400e0 + fixture_id * 53 % 200 AS ea FROM (SELECT * REPLACE (round(edge + 0.02 + (fixture_id % 7) / 100e0, 9) AS edge, round(prob, 9) AS prob) FROM val))",
    ),
)
def _(t: Tables):
    b = valued(t).withColumns({"edge": F.round(F.col("edge") + 0.02 + (ID() % 7) / 100.0, 9), "prob": F.round("prob", 9)})
    b = b.withColumns({"elo_home": F.lit(1400.0) + ID() * 37 % 200, "elo_away": F.lit(1400.0) + ID() * 53 % 200})
    return pk.run_strategies(b, list(pk.STRATEGIES)).select("strategy", "fixture_id", "market", "outcome")


@query(
    "stake_sizes",
    "M32",
    sql(
        """SELECT fixture_id, market, ROUND(10 * m, 6) AS stake_flat, ROUND(250 * GREATEST(0, LEAST(1, (p * odds - (1 - p)) / GREATEST(odds - 1, 1e-9))) * m, 6) AS stake_kelly FROM
        (SELECT *, GREATEST(0.4, 1 / sqrt(COUNT(*) OVER (PARTITION BY CAST(kickoff AS DATE), market))) AS m FROM bets WHERE p * odds - 1 > 0)""",
        "priced",
        BETS_SQL,
    ),
)
def _(t: Tables):
    b = bets(t).filter("ev > 0").withColumn("day", F.to_date("kickoff"))
    return pk.stakes(b).select("fixture_id", "market", "stake_flat", "stake_kelly")


# ---------------------------------------------------------------- settlement and evaluation

LOG_SQL = """lg AS (SELECT fixture_id, kickoff, league, ft_home AS h, ft_away AS a, CASE fixture_id % 5 WHEN 0 THEN '1X2' WHEN 1 THEN 'DC' WHEN 2 THEN 'OU 2.5' WHEN 3 THEN 'OU 3.0' ELSE 'TG Interval' END AS market,
    CASE fixture_id % 5 WHEN 0 THEN CASE fixture_id % 2 WHEN 0 THEN 'H' ELSE 'X' END WHEN 1 THEN '1X' WHEN 2 THEN 'Over' WHEN 3 THEN 'Under' ELSE CASE fixture_id % 3 WHEN 0 THEN '2-3' WHEN 1 THEN '4+' ELSE '2' END END AS selection, 1.5e0 + (fixture_id % 97) / 100e0 AS odds, 10e0 AS stake FROM matches),
  rs AS (SELECT *, CASE WHEN h IS NULL THEN 'PENDING' WHEN market = '1X2' THEN CASE WHEN (selection = 'H' AND h > a) OR (selection = 'X' AND h = a) THEN 'WIN' ELSE 'LOSS' END WHEN market = 'DC' THEN CASE WHEN h >= a THEN 'WIN' ELSE 'LOSS' END
    WHEN market = 'OU 2.5' THEN CASE WHEN h + a > 2.5 THEN 'WIN' ELSE 'LOSS' END WHEN market = 'OU 3.0' THEN CASE WHEN h + a = 3 THEN 'PUSH' WHEN h + a < 3 THEN 'WIN' ELSE 'LOSS' END
    WHEN selection = '2-3' THEN CASE WHEN h + a BETWEEN 2 AND 3 THEN 'WIN' ELSE 'LOSS' END WHEN selection = '4+' THEN CASE WHEN h + a >= 4 THEN 'WIN' ELSE 'LOSS' END ELSE CASE WHEN h + a = 2 THEN 'WIN' ELSE 'LOSS' END END AS result FROM lg),
  settled AS (SELECT *, round(CASE result WHEN 'WIN' THEN stake * odds WHEN 'PUSH' THEN stake ELSE 0 END, 2) AS payout, CASE WHEN result = 'PENDING' THEN 0 ELSE round(CASE result WHEN 'WIN' THEN stake * odds WHEN 'PUSH' THEN stake ELSE 0 END - stake, 2) END AS net FROM rs)"""


def bet_log(t: Tables):
    i = ID()
    market = F.when(i % 5 == 0, "1X2").when(i % 5 == 1, "DC").when(i % 5 == 2, "OU 2.5").when(i % 5 == 3, "OU 3.0").otherwise("TG Interval")
    sel = (
        F.when(i % 5 == 0, F.when(i % 2 == 0, "H").otherwise("X"))
        .when(i % 5 == 1, "1X")
        .when(i % 5 == 2, "Over")
        .when(i % 5 == 3, "Under")
        .otherwise(F.when(i % 3 == 0, "2-3").when(i % 3 == 1, "4+").otherwise("2"))
    )
    return t.matches.select(
        "fixture_id", "kickoff", "league", "ft_home", "ft_away", market.alias("market"), sel.alias("selection"), (1.5 + (i % 97) / 100.0).alias("odds"), F.lit(10.0).alias("stake")
    )


@query("settlement", "M33 P25", sql("SELECT fixture_id, market, result, ROUND(payout, 6) AS payout, ROUND(net, 6) AS net FROM settled", "", LOG_SQL))
def _(t: Tables):
    return st.settle_bets(bet_log(t)).select("fixture_id", "market", "result", "payout", "net")


FIRST_SQL = """fr AS (SELECT league, CAST(kickoff AS DATE) AS d, home, away, ft_home, ft_away FROM scored QUALIFY ROW_NUMBER() OVER (PARTITION BY league, CAST(kickoff AS DATE), home, away ORDER BY kickoff, fixture_id) = 1),
  mm AS (SELECT m.fixture_id, m.kickoff, m.league, fr.ft_home, fr.ft_away FROM matches m LEFT JOIN fr ON m.league = fr.league AND CAST(m.kickoff AS DATE) = fr.d AND m.home = fr.home AND m.away = fr.away),
  """


@query(
    "bet_log_results",
    "J19",
    sql("SELECT fixture_id, market, CAST(h AS BIGINT) AS ft_home, CAST(a AS BIGINT) AS ft_away, result, ROUND(net, 6) AS net FROM settled", "scored", FIRST_SQL + LOG_SQL.replace("FROM matches)", "FROM mm)")),
)
def _(t: Tables):
    """A log of bets, its team names written otherwise, joined to the first result of league, day and teams, and settled."""
    from kickframe.operators.joins import first_match

    names = t.matches.select("fixture_id", *[F.concat(F.lit(" "), F.upper(v)).alias(v) for v in ("home", "away")])
    log = bet_log(t).drop("ft_home", "ft_away").join(names, "fixture_id")
    keyed = lambda df: df.withColumns({"_day": F.to_date("kickoff"), "_h": F.lower(F.trim("home")), "_a": F.lower(F.trim("away"))})
    results = keyed(t.scored).select("league", "_day", "_h", "_a", "kickoff", "fixture_id", "ft_home", "ft_away")
    out = first_match(keyed(log), results, ["league", "_day", "_h", "_a"], ["kickoff", "fixture_id"], ["ft_home", "ft_away"])
    return st.settle_bets(out).select("fixture_id", "market", "ft_home", "ft_away", "result", "net")


@query(
    "running_balance",
    "M34",
    sql("SELECT fixture_id, league, ROUND(1000 + SUM(net) OVER (PARTITION BY league ORDER BY kickoff, fixture_id ROWS UNBOUNDED PRECEDING), 6) AS balance FROM settled", "", LOG_SQL),
)
def _(t: Tables):
    out = st.running_balance(st.settle_bets(bet_log(t)), 1000.0, ["league"], ["kickoff", "fixture_id"], "kickoff")
    return out.select("fixture_id", "league", "balance")


@query(
    "bets_summary",
    "A28",
    sql(
        "SELECT market, COUNT(*) AS bets, ROUND(SUM(stake), 6) AS stake, ROUND(SUM(net), 6) AS profit, ROUND(100 * SUM(net) / SUM(stake), 6) AS roi_pct, ROUND(AVG(CASE WHEN result = 'WIN' THEN 1e0 ELSE 0e0 END), 6) AS win_rate FROM settled WHERE result <> 'PENDING' GROUP BY market",
        "",
        LOG_SQL,
    ),
)
def _(t: Tables):
    s = st.settle_bets(bet_log(t)).filter("result <> 'PENDING'")
    win = (F.col("result") == "WIN").cast("double")
    return s.groupBy("market").agg(
        F.count(F.lit(1)).alias("bets"), F.sum("stake").alias("stake"), F.sum("net").alias("profit"), (100 * F.sum("net") / F.sum("stake")).alias("roi_pct"), F.avg(win).alias("win_rate")
    )


HIT_SQL = (
    PICK_SQL
    + """, hits AS (SELECT *, CASE market WHEN 'OU25_OVER' THEN ft_home + ft_away > 2.5 WHEN 'OU25_UNDER' THEN ft_home + ft_away < 2.5 WHEN 'BTTS_YES' THEN ft_home > 0 AND ft_away > 0 ELSE NOT (ft_home > 0 AND ft_away > 0) END AS hit,
      DENSE_RANK() OVER (PARTITION BY league ORDER BY week) AS round_idx FROM picks)"""
)


def scored_picks(t: Tables):
    """Picks with outcome and round number; rounds are the distinct weeks of a league."""
    p = cut_lineage(picks(t).withColumn("hit", st.won(F.col("market"), F.col("ft_home"), F.col("ft_away"))))
    weeks = ordinal(p.select("league", "week").distinct(), ["league"], ["week"], unix("week"), "round_idx")
    return p.join(weeks, ["league", "week"])


@query(
    "round_groups",
    "A17 L20",
    sql(
        """SELECT league, market, COUNT(*) AS picks, COUNT(*) FILTER (hit) AS wins, COUNT(*) FILTER (NOT hit) AS losses, ROUND(AVG(CAST(hit AS DOUBLE)), 6) AS hit_rate, ROUND(AVG(p_model), 6) AS avg_p, ROUND(AVG(CASE WHEN gate_tier = 'primary' THEN 1e0 ELSE 0e0 END), 6) AS primary_share FROM hits GROUP BY league, market""",
        "priced",
        HIT_SQL,
    ),
)
def _(t: Tables):
    return sm.group_hits(scored_picks(t), ["league", "market"])


@query(
    "picks_per_round",
    "A19",
    sql("SELECT league, round_idx, COUNT(*) AS picks, COUNT(*) FILTER (hit) AS wins FROM hits GROUP BY league, round_idx", "priced", HIT_SQL),
)
def _(t: Tables):
    return scored_picks(t).groupBy("league", "round_idx").agg(F.count(F.lit(1)).alias("picks"), F.count_if("hit").alias("wins"))


@query(
    "round_windows",
    "A18",
    sql(
        """SELECT league, w AS "window", COUNT(*) AS picks, COUNT(*) FILTER (hit) AS wins, ROUND(AVG(CAST(hit AS DOUBLE)), 6) AS hit_rate, COUNT(DISTINCT round_idx) AS rounds, COUNT(*) FILTER (odds > 1.7) AS priced_picks,
        ROUND(AVG(CASE WHEN hit THEN odds - 1 ELSE -1 END) FILTER (odds > 1.7), 6) AS priced_roi FROM hits, (VALUES ('round_1', 1), ('rounds_1_5', 5), ('all', 1000000)) v(w, m) WHERE round_idx <= m GROUP BY league, w""",
        "priced",
        HIT_SQL,
    ),
)
def _(t: Tables):
    labels = F.array_compact(F.array(F.when(F.col("round_idx") <= 1, "round_1"), F.when(F.col("round_idx") <= 5, "rounds_1_5"), F.lit("all")))
    s = scored_picks(t).withColumn("window", F.explode(labels))
    priced = F.col("odds") > 1.7
    profit = F.when(F.col("hit"), F.col("odds") - 1).otherwise(F.lit(-1.0))
    return s.groupBy("league", "window").agg(
        F.count(F.lit(1)).alias("picks"), F.count_if("hit").alias("wins"), F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        F.count_distinct("round_idx").alias("rounds"), F.count_if(priced).alias("priced_picks"), F.avg(F.when(priced, profit)).alias("priced_roi"),
    )


RUN_SQL = """h AS (SELECT league, kickoff, fixture_id, (p_over >= 0.5) = (ft_home + ft_away > 2.5) AS hit FROM priced),
  o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY league ORDER BY kickoff, fixture_id) AS rn FROM h),
  i AS (SELECT league, rn - ROW_NUMBER() OVER (PARTITION BY league ORDER BY rn) AS grp FROM o WHERE NOT hit),
  e AS (SELECT league, rn, SUM(CASE WHEN hit THEN 1 ELSE -1 END) OVER (PARTITION BY league ORDER BY rn ROWS UNBOUNDED PRECEDING) AS eq FROM o),
  p AS (SELECT league, eq - GREATEST(0, MAX(eq) OVER (PARTITION BY league ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS dd FROM e)"""


@query(
    "losing_runs_and_drawdown",
    "W13 W14 X06",
    sql(
        """SELECT league, max_loss_run, ROUND(max_drawdown, 6) AS max_drawdown FROM (SELECT league, MAX(n) AS max_loss_run FROM (SELECT league, COUNT(*) AS n FROM i GROUP BY league, grp) GROUP BY league)
        JOIN (SELECT league, CAST(LEAST(0, MIN(dd)) AS DOUBLE) AS max_drawdown FROM p GROUP BY league) USING (league)""",
        "priced",
        RUN_SQL,
    ),
)
def _(t: Tables):
    hit = (F.col("p_over") >= 0.5) == (F.col("ft_home") + F.col("ft_away") > 2.5)
    df = t.priced.select("league", "kickoff", "fixture_id", hit.alias("hit"), unix("kickoff").alias("cut"))
    df = stored(df)  # read by three windows
    order = ["kickoff", "fixture_id"]
    runs = st.longest_losing_run(df, ["league"], order, F.col("cut"))
    step = F.when(F.col("hit"), 1.0).otherwise(-1.0)
    return runs.join(st.max_drawdown(df, ["league"], order, "cut", step), "league")

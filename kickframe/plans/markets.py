"""Queries on score grids, market books, prices and expected counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kickframe.config import MEAN_LIMITS, MEAN_WEIGHTS
from kickframe.functions.cols import clamp
from kickframe.functions.grids import negbin_pmf
from kickframe.operators import markets as mk
from kickframe.plans.fixtures import Tables, sql
from kickframe.plans.registry import query
from kickframe.plans.summaries import PROF_CTE, bets, goal_rows

PROBS = ["p_home", "p_draw", "p_away", "p_over25", "p_under25", "p_btts_yes", "p_btts_no"]


def grid_sql(n: str, dep: str = "0.08e0", d: str = "sqrt(0.06e0)", rho: str = "-0.04e0") -> str:
    """Brute force over every cell of the grid."""
    pm = "exp(-{l}) * pow({l}, {k}) / factorial(CAST({k} AS INT))"
    return f"""var AS (SELECT fixture_id, mu_home, mu_away, {n} AS n, sh, sa, GREATEST(0.01e0, mu_home * (1 + sh * {d})) AS h, GREATEST(0.01e0, mu_away * (1 + sa * {d})) AS a
      FROM priced, (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) s(sh, sa)),
    rt AS (SELECT *, {dep} * LEAST(h, a) AS lc, h - {dep} * LEAST(h, a) AS lh, a - {dep} * LEAST(h, a) AS la FROM var),
    cells AS (SELECT fixture_id, mu_home, mu_away, sh, sa, x, y, (SELECT NULL) AS z, w, lh, la, lc FROM rt, range(0, 15) gx(x), range(0, 15) gy(y), range(0, 15) gw(w) WHERE x <= n AND y <= n AND w <= LEAST(x, y)),
    pc AS (SELECT fixture_id, mu_home, mu_away, sh, sa, x, y, SUM({pm.format(l='lc', k='w')} * {pm.format(l='lh', k='(x - w)')} * {pm.format(l='la', k='(y - w)')}) AS p FROM cells GROUP BY ALL),
    nm AS (SELECT fixture_id, mu_home, mu_away, x, y, SUM(p / t) / 4e0 AS p FROM pc JOIN (SELECT fixture_id, sh, sa, SUM(p) AS t FROM pc GROUP BY ALL) USING (fixture_id, sh, sa) GROUP BY ALL),
    dc AS (SELECT fixture_id, x, y, p * LEAST(GREATEST(CASE WHEN x = 0 AND y = 0 THEN 1 - mu_home * mu_away * {rho} WHEN x = 0 AND y = 1 THEN 1 + mu_home * {rho}
       WHEN x = 1 AND y = 0 THEN 1 + mu_away * {rho} WHEN x = 1 AND y = 1 THEN 1 - {rho} ELSE 1e0 END, 0.05e0), 5e0) AS p FROM nm),
    tot AS (SELECT fixture_id, SUM(p) AS t, SUM(p) FILTER (x > y) AS h, SUM(p) FILTER (x = y) AS d, SUM(p) FILTER (x + y <= 2) AS u, SUM(p) FILTER (x > 0 AND y > 0) AS b FROM dc GROUP BY fixture_id)"""


GRID_SELECT = """SELECT fixture_id, ROUND(h / t, 6) AS p_home, ROUND(d / t, 6) AS p_draw, ROUND(1 - h / t - d / t, 6) AS p_away, ROUND(1 - u / t, 6) AS p_over25, ROUND(u / t, 6) AS p_under25,
 ROUND(b / t, 6) AS p_btts_yes, ROUND(1 - b / t, 6) AS p_btts_no FROM tot"""


@query("score_grid", "M12 M13 M14 M15", sql(GRID_SELECT, "priced", grid_sql("12")))
def _(t: Tables):
    out = mk.market_probs(t.priced.select("fixture_id", "mu_home", "mu_away"), "mu_home", "mu_away", F.lit(0.08), F.lit(0.06), F.lit(-0.04))
    return out.select("fixture_id", *PROBS)


@query(
    "score_grid_adaptive",
    "M12 M16",
    sql(
        GRID_SELECT,
        "priced",
        grid_sql("CAST(LEAST(GREATEST(ceil(mu_total + 6 * sqrt(mu_total + 1)), 10), 14) AS INT)", dep="0e0", d="0e0", rho="0e0"),
    ),
)
def _(t: Tables):
    n = mk.grid_size(F.col("mu_home"), F.col("mu_away"))
    zero = F.lit(0.0)
    out = mk.market_probs(t.priced.select("fixture_id", "mu_home", "mu_away"), "mu_home", "mu_away", zero, zero, zero, n)
    return out.select("fixture_id", *PROBS)


IND_CTE = """cell AS (SELECT fixture_id, x, y, exp(-mu_home) * pow(mu_home, x) / factorial(CAST(x AS INT)) * exp(-mu_away) * pow(mu_away, y) / factorial(CAST(y AS INT)) AS q FROM priced, range(0, {n}) gx(x), range(0, {n}) gy(y)),
  ncell AS (SELECT fixture_id, x, y, q / SUM(q) OVER (PARTITION BY fixture_id) AS p FROM cell)"""


@query(
    "score_cells_poisson",
    "M18",
    sql(
        "SELECT x, y, COUNT(*) AS n, ROUND(SUM(p), 6) AS mass FROM (SELECT fixture_id, x, y, p / SUM(p) OVER (PARTITION BY fixture_id) AS p FROM ncell WHERE p >= 0.001) GROUP BY x, y",
        "priced",
        IND_CTE.format(n=9),
    ),
)
def _(t: Tables):
    cells = mk.score_cells(t.priced, "mu_home", "mu_away", ["fixture_id"], n=8, trim=0.001)
    return cells.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("mass"))


@query(
    "negbin_totals",
    "M18",
    sql(
        "SELECT fixture_id, ROUND(SUM(p) FILTER (x = 0), 6) AS p0, ROUND(SUM(p) FILTER (x = 2), 6) AS p2, ROUND(SUM(p * x), 6) AS mean FROM (SELECT fixture_id, x, q / SUM(q) OVER (PARTITION BY fixture_id) AS p FROM nb) GROUP BY fixture_id",
        "priced",
        "nb AS (SELECT fixture_id, x, exp(lgamma(x + 4e0) - lgamma(4e0) - lgamma(x + 1e0)) * pow(mu_home / (4 + mu_home), x) AS q FROM priced, range(0, 11) g(x))",
    ),
)
def _(t: Tables):
    df = t.priced.select("fixture_id", negbin_pmf(F.col("mu_home"), F.lit(4.0), 10).alias("pmf"))
    mean = sum((F.get("pmf", F.lit(k)) * k for k in range(11)), F.lit(0.0))
    return df.select("fixture_id", F.get("pmf", F.lit(0)).alias("p0"), F.get("pmf", F.lit(2)).alias("p2"), mean.alias("mean"))


BOOK_CTE = (
    IND_CTE.format(n=11)
    + """,
  marg AS (SELECT fixture_id, SUM(p) FILTER (x > y) AS h, SUM(p) FILTER (x = y) AS d, SUM(p) FILTER (x < y) AS a, SUM(p) FILTER (x + y <= 1) AS u1, SUM(p) FILTER (x + y <= 2) AS u2, SUM(p) FILTER (x + y <= 3) AS u3,
     SUM(p) FILTER (x + y BETWEEN 1 AND 3) AS i13, SUM(p) FILTER (x + y BETWEEN 2 AND 4) AS i24, SUM(p) FILTER (x + y BETWEEN 3 AND 6) AS i36 FROM ncell GROUP BY fixture_id),
  book AS (SELECT fixture_id, '1X2' AS market, 'H' AS outcome, h AS prob FROM marg UNION ALL SELECT fixture_id, '1X2', 'D', d FROM marg UNION ALL SELECT fixture_id, '1X2', 'A', a FROM marg
     UNION ALL SELECT fixture_id, 'DC', '1X', h + d FROM marg UNION ALL SELECT fixture_id, 'DC', '12', h + a FROM marg UNION ALL SELECT fixture_id, 'DC', 'X2', d + a FROM marg
     UNION ALL SELECT fixture_id, 'OU 1.5', 'Under', u1 FROM marg UNION ALL SELECT fixture_id, 'OU 1.5', 'Over', 1 - u1 FROM marg UNION ALL SELECT fixture_id, 'OU 2.5', 'Under', u2 FROM marg
     UNION ALL SELECT fixture_id, 'OU 2.5', 'Over', 1 - u2 FROM marg UNION ALL SELECT fixture_id, 'OU 3.5', 'Under', u3 FROM marg UNION ALL SELECT fixture_id, 'OU 3.5', 'Over', 1 - u3 FROM marg
     UNION ALL SELECT fixture_id, 'TG Interval', '0-1', u1 FROM marg UNION ALL SELECT fixture_id, 'TG Interval', '1-3', i13 FROM marg UNION ALL SELECT fixture_id, 'TG Interval', '2-4', i24 FROM marg
     UNION ALL SELECT fixture_id, 'TG Interval', '3-6', i36 FROM marg)"""
)


def book(t: Tables):
    return mk.market_book(t.priced.select("fixture_id", "mu_home", "mu_away"), "mu_home", "mu_away", ["fixture_id"])


@query("market_book", "M19 M20", sql("SELECT fixture_id, market, outcome, ROUND(prob, 6) AS prob FROM book", "priced", BOOK_CTE))
def _(t: Tables):
    return book(t)


VAL_CTE = (
    BOOK_CTE
    + """,
  pricedbook AS (SELECT *, CASE WHEN fixture_id % 3 = 0 AND market LIKE 'OU%' THEN NULL ELSE round(1 / (prob * 1.04 + 0.01), 2) END AS raw FROM book),
  s1 AS (SELECT *, CASE WHEN raw IS NULL THEN 'synth' ELSE 'real' END AS price_source, GREATEST(1.01e0, COALESCE(raw, 1 / GREATEST(1e-6, prob / SUM(prob) OVER (PARTITION BY fixture_id, market) * 1.06))) AS odds FROM pricedbook),
  val AS (SELECT *, prob - (1 / odds) / SUM(1 / odds) OVER (PARTITION BY fixture_id, market) AS edge, CASE WHEN price_source = 'real' THEN prob * odds - 1 END AS ev FROM s1)"""
)


def valued(t: Tables):
    gap = F.col("fixture_id") % 3 == 0
    price = lambda m, o, p: F.when(~gap if m.startswith("OU") else F.lit(True), F.round(1 / (p * 1.04 + 0.01), 2))
    return mk.valued_book(t.priced.select("fixture_id", "mu_home", "mu_away"), "mu_home", "mu_away", ["fixture_id"], price)


@query(
    "value_metrics",
    "M02 M03 M04",
    sql("SELECT fixture_id, market, outcome, price_source, ROUND(odds, 6) AS odds, ROUND(1 / GREATEST(prob, 1e-9), 6) AS fair_odds, ROUND(edge, 6) AS edge, ROUND(ev, 6) AS ev FROM val", "priced", VAL_CTE),
)
def _(t: Tables):
    return valued(t).select("fixture_id", "market", "outcome", "price_source", "odds", "fair_odds", "edge", "ev")


@query(
    "placeholder_prices",
    "M05",
    sql(
        "SELECT market, COUNT(*) AS n, ROUND(AVG(CASE WHEN market LIKE 'OU%' OR market = '1X2' THEN 2e0 WHEN market = 'DC' THEN 1.33e0 ELSE 3e0 END), 6) AS odds FROM book GROUP BY market",
        "priced",
        BOOK_CTE,
    ),
)
def _(t: Tables):
    b = book(t).withColumn("odds", mk.placeholder_odds(F.col("market")))
    return b.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.avg("odds").alias("odds"))


@query(
    "implied_probabilities",
    "M01 M02",
    sql(
        """SELECT fixture_id, ROUND((1 / odds_over) / (COALESCE(1 / odds_over, 0) + COALESCE(1 / odds_under, 0)), 6) AS p_over_imp, ROUND((1 / odds_yes) / NULLIF(COALESCE(1 / odds_yes, 0) + COALESCE(1 / odds_no, 0) + COALESCE(1 / odds_over, 0), 0), 6) AS p_three_way,
        ROUND(p_over * odds_over - 1, 6) AS ev_over, ROUND(p_over - 1 / odds_over, 6) AS value_margin FROM priced""",
        "priced",
    ),
)
def _(t: Tables):
    return t.priced.select(
        "fixture_id",
        mk.implied("odds_over", "odds_under")[0].alias("p_over_imp"),
        mk.implied("odds_yes", "odds_no", "odds_over")[0].alias("p_three_way"),
        mk.expected_value("p_over", "odds_over").alias("ev_over"),
        (F.col("p_over") - 1 / F.col("odds_over")).alias("value_margin"),
    )


@query(
    "shortest_total_interval",
    "T14",
    sql(
        """SELECT fixture_id, span FROM (SELECT fixture_id, CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) AS span, ROW_NUMBER() OVER (PARTITION BY fixture_id ORDER BY b - a, a) AS k FROM
        (SELECT s.fixture_id, s.t AS a, e.t AS b FROM cum s JOIN cum e ON s.fixture_id = e.fixture_id AND e.t >= s.t WHERE e.c - s.c + s.p >= 0.8)) WHERE k = 1""",
        "priced",
        IND_CTE.format(n=9)
        + ", tot AS (SELECT fixture_id, x + y AS t, SUM(p) AS p FROM ncell GROUP BY ALL), cum AS (SELECT *, SUM(p) OVER (PARTITION BY fixture_id ORDER BY t) AS c FROM tot)",
    ),
)
def _(t: Tables):
    df = t.priced.select("fixture_id", "mu_home", "mu_away")
    return mk.shortest_interval(df, "mu_home", "mu_away", 0.8, n=8).select("fixture_id", "span")


@query(
    "fused_means",
    "M21 M22",
    sql(
        """SELECT fixture_id, ROUND(0.7e0 * mu_home + 0.3e0 * 1.4e0, 6) AS with_prior, ROUND(COALESCE(0.6e0 * mu_home + 0.4e0 * shots_h / 10, mu_home), 6) AS with_second, ROUND(0.9e0 * p_over + 0.1e0 * 0.5e0, 6) AS shrunk FROM priced""",
        "priced",
    ),
)
def _(t: Tables):
    return t.priced.select(
        "fixture_id",
        mk.blend("mu_home", F.lit(1.4), 0.3).alias("with_prior"),
        mk.blend("mu_home", F.col("shots_h") / 10, 0.4).alias("with_second"),
        mk.blend("p_over", F.lit(0.5), 0.1).alias("shrunk"),
    )


@query(
    "fused_grid",
    "M21",
    sql(
        """SELECT fixture_id, ROUND(SUM(0.3e0 * q1 / t1 + 0.7e0 * q2 / t2) FILTER (x > y), 6) AS p_home, ROUND(SUM(0.3e0 * q1 / t1 + 0.7e0 * q2 / t2) FILTER (x = y), 6) AS p_draw FROM
        (SELECT *, SUM(q1) OVER (PARTITION BY fixture_id) AS t1, SUM(q2) OVER (PARTITION BY fixture_id) AS t2 FROM (SELECT fixture_id, x, y, exp(-mu_home - 1.1e0) * pow(mu_home, x) * pow(1.1e0, y) / factorial(CAST(x AS INT)) / factorial(CAST(y AS INT)) AS q1,
          exp(-mu_home - mu_away) * pow(mu_home, x) * pow(mu_away, y) / factorial(CAST(x AS INT)) / factorial(CAST(y AS INT)) AS q2 FROM priced, range(0, 11) gx(x), range(0, 11) gy(y))) GROUP BY fixture_id""",
        "priced",
    ),
)
def _(t: Tables):
    base = t.priced.select("fixture_id", "mu_home", "mu_away", F.lit(1.1).alias("alt_away"))
    pick = lambda a: mk.market_book(base, "mu_home", a, ["fixture_id"], lines=(), intervals=()).filter("market = '1X2' AND outcome <> 'A'")
    first, second = pick("alt_away").withColumn("w", F.lit(0.3)), pick("mu_away").withColumn("w", F.lit(0.7))
    both = first.unionByName(second)
    at = lambda o: F.sum(F.when(F.col("outcome") == o, F.col("w") * F.col("prob")))
    return both.groupBy("fixture_id").agg(at("H").alias("p_home"), at("D").alias("p_draw"))


@query(
    "goal_timing_rates",
    "M23",
    sql(
        """SELECT fixture_id, ROUND((l0 + l1) / mt, 6) AS early_share, ROUND(l5 / mt, 6) AS late_share, ROUND(1 - exp(-(l0 + l1 + l2)), 6) AS p_1h_goal, ROUND(1 - exp(-(l3 + l4 + l5)) * (1 + l3 + l4 + l5), 6) AS p_2h_two,
        ROUND(1 - exp(-l5), 6) AS p_goal_after_75, CAST((l0 + l1) / mt < pe - 0.05 AS BIGINT) AS slow_start, CAST(l5 / mt > pl + 0.07 AS BIGINT) AS late_goals FROM lam""",
        "priced",
        PROF_CTE
        + """, pri AS (SELECT """
        + ", ".join(f"SUM(scored_{i}) / SUM(scored) AS r{i}" for i in range(6))
        + """ FROM prof), d AS (SELECT team, """
        + ", ".join(f"CASE WHEN scored > 0 THEN scored_{i} / scored ELSE r{i} END AS s{i}, CASE WHEN conceded > 0 THEN conceded_{i} / conceded ELSE r{i} END AS c{i}" for i in range(6))
        + """ FROM prof, pri), lam AS (SELECT p.fixture_id, mu_total AS mt, r0 + r1 AS pe, r5 AS pl, """
        + ", ".join(f"mu_home * (h.s{i} + a.c{i}) / 2 + mu_away * (a.s{i} + h.c{i}) / 2 AS l{i}" for i in range(6))
        + " FROM priced p JOIN d h ON p.home = h.team JOIN d a ON p.away = a.team, pri)",
    ),
)
def _(t: Tables):
    from kickframe.operators.summaries import timing_profiles

    prof = timing_profiles(goal_rows(t))
    overall = prof.agg(*[(F.sum(f"scored_{i}") / F.sum("scored")).alias(f"r{i}") for i in range(6)])
    prior = overall.select(F.array(*[F.col(f"r{i}") for i in range(6)]).alias("r")).select("r").scalar()
    prof = prof.withColumn("_r", prior)

    def shares(kind: str):
        own = F.array(*[F.try_divide(F.col(f"{kind}_{i}"), F.col(kind)) for i in range(6)])
        return F.when(F.col(kind) > 0, own).otherwise(F.col("_r"))

    prof = prof.select("team", shares("scored").alias("sc"), shares("conceded").alias("co"), F.col("_r"))
    side = lambda s: prof.select(F.col("team").alias({"h": "home", "a": "away"}[s]), F.col("sc").alias(f"sc_{s}"), F.col("co").alias(f"co_{s}"), *([F.col("_r").alias("r")] if s == "h" else []))
    df = t.priced.select("fixture_id", "home", "away", "mu_home", "mu_away").join(side("h"), "home").join(side("a"), "away")
    df = df.withColumns({"prior_early": F.get("r", 0) + F.get("r", 1), "prior_late": F.get("r", 5)})
    out = mk.timing_rates(df)
    return out.select("fixture_id", "early_share", "late_share", "p_1h_goal", "p_2h_two", "p_goal_after_75", "slow_start", "late_goals")


@query(
    "side_decisions",
    "M24 P32",
    sql(
        """SELECT fixture_id, CASE WHEN p_over >= p_under THEN 'OU25_OVER' ELSE 'OU25_UNDER' END AS pred_ou, CASE WHEN p_btts >= CASE league WHEN 'NATION_3' THEN 0.6 WHEN 'NATION_4' THEN 0.4 ELSE 0.5 END THEN 'BTTS_YES' ELSE 'BTTS_NO' END AS pred_btts FROM priced""",
        "priced",
    ),
)
def _(t: Tables):
    from kickframe.functions.text import from_map

    limit = clamp(from_map(F.col("league"), {"NATION_3": 0.6, "NATION_4": 0.4}, 0.5), 0.0, 1.0)
    return t.priced.select(
        "fixture_id",
        F.when(F.col("p_over") >= F.col("p_under"), "OU25_OVER").otherwise("OU25_UNDER").alias("pred_ou"),
        F.when(F.col("p_btts") >= limit, "BTTS_YES").otherwise("BTTS_NO").alias("pred_btts"),
    )


MEAN_SQL = """inp AS (SELECT fixture_id, CASE WHEN fixture_id % 8 = 0 THEN NULL ELSE mu_home END AS lg_home, mu_away AS lg_away, CASE WHEN fixture_id % 5 = 0 THEN NULL ELSE mu_home + 0.2 END AS sgh, CASE WHEN fixture_id % 5 = 0 OR fixture_id % 3 = 0 THEN NULL ELSE mu_away - 0.1 END AS sah,
     CASE WHEN fixture_id % 5 = 0 THEN NULL ELSE mu_away END AS sga, CASE WHEN fixture_id % 5 = 0 THEN NULL ELSE mu_home END AS saa, shots_h / 8e0 AS xfh, shots_a / 8e0 AS xah, shots_a / 9e0 AS xfa, shots_h / 9e0 AS xaa,
     fixture_id % 4 > 0 AS xok, CASE WHEN fixture_id % 6 <> 0 THEN p_over END AS ph, p_under AS pa, fixture_id % 7 > 0 AS pok, p_btts AS dh, 1 - p_btts AS da FROM priced),
   anc AS (SELECT *, LEAST(GREATEST(COALESCE(lg_home, 1.35e0), 0.2e0), 3.5e0) AS ah, LEAST(GREATEST(lg_away, 0.2e0), 3.5e0) AS aa, COALESCE(ph, 0.5e0) AS p1, pa AS p2 FROM inp),
   md AS (SELECT *, LEAST(GREATEST(COALESCE((COALESCE(sgh, saa) + COALESCE(saa, sgh)) / 2, ah), 0.2e0), 3.5e0) AS rh, LEAST(GREATEST(COALESCE((COALESCE(sga, sah) + COALESCE(sah, sga)) / 2, aa), 0.2e0), 3.5e0) AS ra,
     CASE WHEN xok THEN LEAST(GREATEST((xfh + xaa) / 2, 0.2e0), 3.5e0) ELSE ah END AS xh, CASE WHEN xok THEN LEAST(GREATEST((xfa + xah) / 2, 0.2e0), 3.5e0) ELSE aa END AS xa,
     LEAST(GREATEST((p1 + 1 - p2) / 2 / ((p1 + 1 - p2) / 2 + (p2 + 1 - p1) / 2), 0.25e0), 0.75e0) AS sh, GREATEST(ah + aa, 0.4e0) * LEAST(GREATEST(1 + 0.7e0 * (((p1 + dh) / 2 + (p2 + da) / 2) / 2 - 0.5e0), 0.85e0), 1.15e0) AS mt FROM anc),
   fin AS (SELECT *, CASE WHEN pok THEN LEAST(GREATEST(mt * sh, 0.2e0), 3.5e0) ELSE ah END AS qh, CASE WHEN pok THEN LEAST(GREATEST(mt * (1 - sh), 0.2e0), 3.5e0) ELSE aa END AS qa FROM md)"""


@query(
    "blended_means",
    "M06 M07 M08 M09 M10",
    sql(
        """SELECT fixture_id, ROUND(LEAST(GREATEST(0.4e0 * ah + 0.1e0 * rh + 0.25e0 * xh + 0.25e0 * qh, 0.2e0), 3.5e0), 6) AS mu_home, ROUND(LEAST(GREATEST(0.4e0 * aa + 0.1e0 * ra + 0.25e0 * xa + 0.25e0 * qa, 0.2e0), 3.5e0), 6) AS mu_away,
        ROUND(rh, 6) AS mu_rating_home, ROUND(xa, 6) AS mu_xg_away, ROUND(qh, 6) AS mu_pressure_home, concat_ws('|', CASE WHEN COALESCE(sgh, sah, sga, saa) IS NULL THEN 'elo' END, CASE WHEN NOT xok THEN 'xg' END, CASE WHEN NOT pok THEN 'pressure' END) AS neutralised FROM fin""",
        "priced",
        MEAN_SQL,
    ),
)
def _(t: Tables):
    i = F.col("fixture_id")
    some = lambda cond, c: F.when(cond, c)
    inp = t.priced.select(
        "fixture_id",
        some(i % 8 != 0, F.col("mu_home")).alias("lg_home"), F.col("mu_away").alias("lg_away"),
        some(i % 5 != 0, F.col("mu_home") + 0.2).alias("sim_gf_h"), some((i % 5 != 0) & (i % 3 != 0), F.col("mu_away") - 0.1).alias("sim_ga_h"),
        some(i % 5 != 0, F.col("mu_away")).alias("sim_gf_a"), some(i % 5 != 0, F.col("mu_home")).alias("sim_ga_a"),
        (F.col("shots_h") / 8.0).alias("xg_for_h"), (F.col("shots_a") / 8.0).alias("xg_against_h"), (F.col("shots_a") / 9.0).alias("xg_for_a"), (F.col("shots_h") / 9.0).alias("xg_against_a"),
        (i % 4).alias("xg_usable"), some(i % 6 != 0, F.col("p_over")).alias("press_h"), F.col("p_under").alias("press_a"), (i % 7).alias("pressure_usable"),
        F.col("p_btts").alias("dom_shots_h"), (1 - F.col("p_btts")).alias("dom_shots_a"),
    )
    out = mk.blended_means(inp, MEAN_WEIGHTS, MEAN_LIMITS)
    return out.select("fixture_id", "mu_home", "mu_away", "mu_rating_home", "mu_xg_away", "mu_pressure_home", "neutralised")


@query(
    "signal_fusion",
    "M36",
    sql(
        """SELECT fixture_id, ROUND(LEAST(GREATEST(0.7e0 * p_over + 0.3e0 * (0.6e0 / (1 + exp(-1.2e0 * (shots_h - shots_a) / 10)) + 0.4e0 / (1 + exp(-0.8e0 * (fixture_id % 300 - 150) / 200))), 0), 1), 6) AS p_fused FROM priced""",
        "priced",
    ),
)
def _(t: Tables):
    w = {"form": 0.6, "elo": 0.4, "slope_strength": 1.2, "slope_elo": 0.8, "model": 0.7, "signal": 0.3}
    gap = (F.col("shots_h") - F.col("shots_a")) / 10
    return t.priced.select("fixture_id", mk.fuse_signal(F.col("p_over"), gap, F.col("fixture_id") % 300 - 150, w).alias("p_fused"))


@query(
    "price_priority",
    "M35",
    sql(
        """SELECT fixture_id, ROUND(CASE WHEN fixture_id % 3 = 0 AND odds_over > 0 AND odds_under > 0 THEN odds_over WHEN fixture_id % 5 <> 0 THEN odds_yes END, 6) AS odds_1, ROUND(CASE WHEN fixture_id % 3 = 0 AND odds_over > 0 AND odds_under > 0 THEN odds_under WHEN fixture_id % 5 <> 0 THEN odds_no END, 6) AS odds_2 FROM priced""",
        "priced",
    ),
)
def _(t: Tables):
    i = F.col("fixture_id")
    feed = t.priced.select(
        "fixture_id", F.when(i % 3 == 0, F.col("odds_over")).alias("b1_a"), F.col("odds_under").alias("b1_b"),
        F.when(i % 5 != 0, F.col("odds_yes")).alias("b2_a"), F.col("odds_no").alias("b2_b"),
    )
    valid = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.struct(F.col(a).alias("x"), F.col(b).alias("y")))
    best = feed.withColumn("p", F.coalesce(valid("b1_a", "b1_b"), valid("b2_a", "b2_b")))
    return best.select("fixture_id", F.col("p.x").alias("odds_1"), F.col("p.y").alias("odds_2"))

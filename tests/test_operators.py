"""Operators against brute force on small frames, in particular the paths taken by very large keys."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kickframe.functions.text import fold_name, minutes_list, season_label, split_pair
from kickframe.operators import joins as jn
from kickframe.operators import markets as mk
from kickframe.operators import ratings as rt
from kickframe.operators import settle as st
from kickframe.operators import xg
from kickframe.operators.clean import parse_dates
from kickframe.operators.picks import PickRules, select_picks


@pytest.fixture(scope="module")
def league(spark):
    rnd = random.Random(11)
    data = []
    for i in range(160):
        h, a = rnd.sample(range(6), 2)
        score = (None, None) if i % 17 == 0 else (rnd.randrange(5), rnd.randrange(4))
        data.append((i, "L", f"T{h}", f"T{a}", 1_000_000_000 + (i // 2) * 5 * 86400, *score))
    df = spark.createDataFrame(data, "fixture_id long, league string, home string, away string, t long, ft_home int, ft_away int")
    return df.withColumn("kickoff", F.timestamp_seconds("t").cast("timestamp_ntz")).cache()


def walked(rows, rules):
    """The plain loop over matches in order."""
    state = {}
    for m in rows:
        yield (m.fixture_id, *rt.apply_match(m, state, rules))


@pytest.mark.parametrize("chunk", [40, 1000])
def test_ratings_in_chunks_equal_the_walk(league, chunk):
    rules = rt.EloRules(floor=1490.0)  # a floor that is reached
    got = {r["fixture_id"]: r for r in rt.elo_series(league, "league", rules, chunk_rows=chunk).collect()}
    rows = rt._static(league, rules).orderBy("kickoff", "home", "away", "fixture_id").collect()
    want = {w[0]: w[1:] for w in walked(rows, rules)}
    assert got.keys() == want.keys() and len(want) == 160
    for i, row in want.items():
        for c, w in zip(rt.TRACE, row, strict=True):
            assert (got[i][c] is None) == (w is None) and (w is None or abs(got[i][c] - w) < 1e-6), (i, c)


def test_one_long_pool_walks_in_many_tasks(spark):
    """200,000 matches of one pool in ten chunks equal the plain loop."""
    i = F.col("id")
    df = spark.range(200_000).select(
        i.alias("fixture_id"), F.lit("L").alias("league"), F.concat(F.lit("T"), i * 7 % 40).alias("home"), F.concat(F.lit("T"), (i * 7 + 1 + i * i % 39) % 40).alias("away"),
        F.timestamp_seconds(1_000_000_000 + (i / 3).cast("long") * 1800).cast("timestamp_ntz").alias("kickoff"), (F.xxhash64(i) % 5).alias("a"), (F.xxhash64(i + 7) % 4).alias("b"),
    )
    df = df.withColumns({"ft_home": F.abs("a").cast("int"), "ft_away": F.when(F.col("fixture_id") % 31 != 0, F.abs("b").cast("int"))}).drop("a", "b")
    from kickframe.functions.cols import unix
    from kickframe.operators.ordered import sliced

    assert sliced(df, ["league"], unix("kickoff"), rt.CHUNK).select("_slice").distinct().count() >= 8
    rules = rt.EloRules()
    got = rt.elo_series(df, "league", rules).orderBy("fixture_id").toPandas()
    rows = rt._static(df, rules).orderBy("kickoff", "home", "away", "fixture_id").toPandas()
    want = pd.DataFrame(walked(rows.itertuples(), rules), columns=["fixture_id", *rt.TRACE]).sort_values("fixture_id", ignore_index=True)
    assert len(got) == 200_000
    for c in rt.TRACE:
        assert (got[c].isna() == want[c].isna()).all() and (got[c] - want[c].astype(float)).abs().max() < 1e-6, c


def test_kernel_over_many_blocks_equals_pairs(spark):
    rnd = random.Random(3)
    data = [(i, "A", "home", 1_000_000_000 + (i // 2) * 86400, 1500 + rnd.gauss(0, 90), rnd.randrange(5), rnd.randrange(4)) for i in range(150)]
    df = spark.createDataFrame(data, "fixture_id long, team string, venue string, t long, opp_elo double, gf int, ga int")
    df = df.withColumn("kickoff", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = {r["fixture_id"]: r for r in jn.kernel_history(df, block_rows=20).collect()}
    for i, _, _, t, target, _, _ in data:
        past = [(r, g, a) for _, _, _, pt, r, g, a in data if pt < t]
        if not past:
            assert got[i]["gf_sim"] is None and got[i]["neff"] == 0
            continue
        w = np.array([math.exp(-((r - target) ** 2) / (2 * 60.0**2)) for r, _, _ in past])
        g = np.array([x for _, x, _ in past], float)
        mean, neff = (w * g).sum() / w.sum(), w.sum() ** 2 / (w**2).sum()
        if neff < 5:
            al = min(1.0, neff / 10)
            mean = al * mean + (1 - al) * g.mean()
        assert abs(got[i]["gf_sim"] - mean) < 1e-8 and abs(got[i]["neff"] - neff) < 1e-6, (i, got[i], mean, neff)


def test_kernel_with_many_ties_and_far_ratings(spark):
    ties = spark.range(50_000).select((F.col("id") + 10).alias("fixture_id"), F.lit(2_000_000_000).alias("t"), F.lit(1500.0).alias("opp_elo"))
    past = spark.createDataFrame([(i, 1_000_000_000 + i, 1500.0 + 300 * i) for i in range(5)], "fixture_id long, t int, opp_elo double")
    df = past.unionByName(ties).select("*", F.lit("A").alias("team"), F.lit("home").alias("venue"), F.col("fixture_id").cast("int").alias("gf"), F.lit(1).alias("ga"), F.timestamp_seconds("t").cast("timestamp_ntz").alias("kickoff"))
    for rows in (2, 1024):
        got = jn.kernel_history(df, block_rows=rows)
        w = np.exp(-0.5 * (300 * np.arange(5) / 60.0) ** 2)
        mean, neff = (w * np.arange(5)).sum() / w.sum(), w.sum() ** 2 / (w * w).sum()
        want = neff / 10 * mean + (1 - neff / 10) * 2.0
        r = got.where("fixture_id >= 10").agg(F.count("*").alias("n"), F.min("gf_sim").alias("lo"), F.max("gf_sim").alias("hi")).first()
        assert r["n"] == 50_000 and abs(r["lo"] - want) < 1e-9 and abs(r["hi"] - want) < 1e-9
        # one past match 5 sigma away, in the same block or in an earlier one, counts alike
        assert abs(got.where("fixture_id = 1").first()["neff"] - 1.0) < 1e-6


def test_walk_forward_equals_direct_fits(league):
    from kickframe.operators.sides import side_rows

    rnd = np.random.default_rng(1)
    stats = league.sparkSession.createDataFrame([(i, float(rnd.integers(3, 20)), float(rnd.integers(3, 20))) for i in range(160)], "fixture_id long, shots_h double, shots_a double")
    s = side_rows(league.join(stats, "fixture_id"), {"gf": ("ft_home", "ft_away"), "sf": ("shots_h", "shots_a"), "sa": ("shots_a", "shots_h")}, keep=("fixture_id", "kickoff"))
    s = s.withColumn("week", xg.week_index("kickoff")).cache()
    got = {(r["fixture_id"], r["venue"]): r["xg"] for r in xg.walk_forward(s, ["sf", "sa"], refit_weeks=1).collect()}
    rows = s.toPandas()
    train_all = rows[rows.gf.notna()]
    checked = 0
    for week in sorted(rows.week.unique())[::10]:
        tr, te = train_all[train_all.week < week], rows[rows.week == week]
        if len(tr) < 30:
            continue
        x, y = tr[["sf", "sa"]].to_numpy(float), tr.gf.to_numpy(float)
        m, sd = x.mean(0), x.std(0)
        z = np.column_stack([np.ones(len(x)), (x - m) / sd])
        b = np.array([math.log(y.mean()), 0, 0])
        pen = np.diag([0, 0.1, 0.1])
        for _ in range(50):
            mu = np.exp(z @ b)
            b = b - np.linalg.solve((z * mu[:, None]).T @ z / len(y) + pen, z.T @ (mu - y) / len(y) + pen @ b)
        for r in te.itertuples():
            want = math.exp(b[0] + b[1:] @ ((np.array([r.sf, r.sa]) - m) / sd))
            assert abs(got[(r.fixture_id, r.venue)] - want) < 1e-6
            checked += 1
    assert checked > 10


def test_head_to_head_both_ways_and_window_edge(spark):
    d = 86400
    data = [(1, "A", "B", 0, 3, 0), (2, "B", "A", 10 * d, 2, 2), (3, "A", "B", 5 * 365 * d, 1, 0), (4, "A", "B", 5 * 365 * d + 1, 0, 0)]
    df = spark.createDataFrame(data, "fixture_id long, home string, away string, t long, ft_home int, ft_away int").withColumn("kickoff", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = {r["fixture_id"]: r for r in jn.head_to_head(df).collect()}
    assert [got[i]["h2h_matches"] for i in (1, 2, 3, 4)] == [0, 1, 2, 2]  # exactly five years back counts, one second more does not
    assert got[2]["h2h_home_win_rate"] == 0.0 and got[3]["h2h_home_win_rate"] == 0.5 and got[1]["h2h_goals_avg"] == 2.5


def test_alias_suggestions_match_all_pairs(spark):
    rnd = random.Random(6)
    words = ["arsenal", "aston villa", "chelsea", "everton", "manchester city", "manchester united", "newcastle united", "inter", "ab", ""]
    names = sorted({w + x for w in words for x in ("", " fc", " ii", "a")})

    def changed(w):
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:k] + "x" + w[k:], w[:k] + w[k + 1 :], w[:k] + "y" + w[k + 1 :]])
        return w

    odd = sorted({changed(rnd.choice(names)) for _ in range(150)} | {"zzz", "q"})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    mk_df = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = {r["unknown"]: (r["canonical"], r["auto"]) for r in jn.alias_suggestions(mk_df(odd), mk_df(names)).collect()}
    assert set(got) == set(odd)
    for u in odd:
        score, best = max((1 - edits(u, c) / max(len(u), len(c), 1), c) for c in names)
        assert got[u] == ((best, score >= 0.92) if score >= 0.75 else (None, False)), (u, got[u], score, best)


def test_text_functions(spark):
    row = spark.range(1).select(
        fold_name(F.lit("  1. FC Köln–Süd ")).alias("a"), fold_name(F.lit("1. FC Köln"), loose=True).alias("b"), minutes_list(F.lit("37,H49 45+2;x 131")).alias("c"),
        season_label(F.lit("24.0")).alias("d"), split_pair(F.lit("3,5-2"))[0].alias("e"), season_label(F.lit("2023-2024")).alias("f"),
    ).first()
    assert row["a"] == "1 fc kolnsud" and row["b"] == "koln" and row["c"] == [37, 49, 45] and row["d"] == "2024-2025" and row["e"] == 3.5 and row["f"] == "2023-2024"


@pytest.mark.parametrize(("raws", "want"), [(["05/04/2020", "25/04/2020", "13/01/2020"], "2020-04-05"), (["05/04/2020", "04/25/2020"], "2020-05-04"), (["05/04/2020"], "2020-05-04")])
def test_date_vote(spark, raws, want):
    df = spark.createDataFrame([(x,) for x in raws], "raw string")
    assert parse_dates(df, "raw", "day").filter(F.col("raw") == "05/04/2020").select(F.date_format("day", "yyyy-MM-dd")).first()[0] == want


def test_grid_without_dependence_is_the_product(spark):
    df = spark.createDataFrame([(1, 1.4, 0.9), (2, 0.0, 0.5)], "id int, h double, a double")
    zero = F.lit(0.0)
    got = {r["id"]: r for r in mk.market_probs(df, "h", "a", zero, zero, zero, 14).collect()}
    assert abs(got[1]["p_btts_yes"] - (1 - math.exp(-1.4)) * (1 - math.exp(-0.9))) < 1e-6
    assert abs(got[1]["p_home"] + got[1]["p_draw"] + got[1]["p_away"] - 1) < 1e-12


def test_quota_prefers_first_tier_only_when_full(spark):
    base = dict(mu_home=1.5, mu_away=1.3, mu_total=2.8, p_under=0.3, odds_over=2.0, odds_under=2.0, odds_yes=None, odds_no=None, neff_a=9.0, press_n_h=9.0, press_n_a=9.0, xg_n_h=9.0, xg_n_a=9.0, sterile=0, assassin=0, slow_start=0, late_goal=0)
    rows = []
    for i in range(12):
        league = "full" if i < 6 else "short"
        strong = (i % 6) < (4 if league == "full" else 3)
        rows.append(dict(base, fixture_id=i, league=league, week=1, p_over=0.6 + i / 100, neff_h=9.0 if strong else 2.0))
    df = spark.createDataFrame(rows, "fixture_id long, league string, week int, mu_home double, mu_away double, mu_total double, p_over double, p_under double, odds_over double, odds_under double, odds_yes double, odds_no double, neff_h double, neff_a double, press_n_h double, press_n_a double, xg_n_h double, xg_n_a double, sterile int, assassin int, slow_start int, late_goal int")
    rules = PickRules(evidence_primary={"full": (5.0, 1.0, 1.0), "short": (5.0, 1.0, 1.0)})
    got = select_picks(df, rules, ["league", "week"], ["fixture_id", "league", "sterile", "assassin", "slow_start", "late_goal"]).collect()
    assert sum(r["league"] == "full" for r in got) == 4 and all(r["gate_tier"] == "primary" for r in got if r["league"] == "full")
    assert sum(r["league"] == "short" for r in got) == 5


def test_settlement_push_and_pending(spark):
    rows = [("OU 3.0", "Over", 2, 1, "PUSH"), ("OU 2.5", "Under", 2, 1, "LOSS"), ("TG Interval", "4+", 2, 2, "WIN"), ("1X2", "X", 1, 1, "WIN"), ("DC", "12", 1, 1, "LOSS"), ("1X2", "H", None, None, "PENDING")]
    df = spark.createDataFrame([(m, s, 2.0, 10.0, h, a, w) for m, s, h, a, w in rows], "market string, selection string, odds double, stake double, ft_home int, ft_away int, want string")
    assert all(r["result"] == r["want"] for r in st.settle_bets(df).collect())


def test_row_local_book_equals_the_windowed_one(spark):
    df = spark.createDataFrame([(i, 0.6 + i / 20, 0.5 + i / 18) for i in range(40)], "fixture_id long, h double, a double")
    price = lambda m, o, p: F.when(F.col("fixture_id") % 3 != 0, F.round(1 / (p * 1.04 + 0.01), 2)) if m != "DC" else F.lit(None).cast("double")
    flat = mk.market_book(df, "h", "a", ["fixture_id"])
    odds = F.when((F.col("market") != "DC") & (F.col("fixture_id") % 3 != 0), F.round(1 / (F.col("prob") * 1.04 + 0.01), 2))
    want = {(r["fixture_id"], r["market"], r["outcome"]): r for r in mk.value_book(flat.withColumn("odds", odds), ["fixture_id"]).collect()}
    got = mk.valued_book(df, "h", "a", ["fixture_id"], price)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == len(want) == 640
    for r in rows:
        w = want[r["fixture_id"], r["market"], r["outcome"]]
        for c in ("prob", "odds", "p_imp", "fair_odds", "p_imp_norm", "edge", "ev"):
            assert (r[c] is None) == (w[c] is None) and (r[c] is None or abs(r[c] - w[c]) < 1e-12)
        assert r["price_source"] == w["price_source"]


def test_aligned_outputs_and_first_matches(spark):
    base = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("b", 2, 12), (None, 3, 13), ("d", 4, 14)], "k string, d int, v int")
    cand = spark.createDataFrame([("a", 1, 20), (None, 3, 21), ("b", 9, 22), ("a", 1, 23)], "k string, d int, v int")
    b, c = jn.aligned(base, cand, ["k", "d"])
    assert sorted(r["v"] for r in b.collect()) == [10, 11, 13] and sorted(r["v"] for r in c.collect()) == [20, 21, 23]
    right = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("a", 3, 1), (None, 1, 9)], "k string, at int, goals int")
    left = spark.createDataFrame([("a", 0), ("x", 1), (None, 2)], "k string, id int")
    got = {r["id"]: r["goals"] for r in jn.first_match(left, right, ["k"], ["at", "goals"], ["goals"]).collect()}
    assert got == {0: 1, 1: None, 2: None}


def test_strengths_zero_every_score_equation(spark):
    from kickframe.operators import models as ml

    rnd = random.Random(6)
    rows = [(f"T{i}", f"T{j}", v, 1, 0.2 + rnd.random(), rnd.randrange(4) * (0.2 + rnd.random())) for i in range(7) for j in range(7) if i != j for v in ("home", "away")]
    rows = [(*r[:5], 0.0 if r[0] == "T6" else r[5]) for r in rows]  # one team never scores
    cells = spark.createDataFrame(rows, "team string, opp string, venue string, rows long, w double, wy double")
    attack, defence, venue = ml.decayed_strengths(cells)
    fitted = ml.strength_means(cells, attack, defence, venue).toPandas()
    for key in ("team", "opp", "venue"):
        assert (fitted.assign(s=fitted.wy - fitted.w * fitted.mu).groupby(key).s.sum().abs() < 1e-7).all()
    assert fitted[fitted.team == "T6"].mu.max() == 0
    new = ml.strength_means(spark.createDataFrame([("T0", "new", "home")], "team string, opp string, venue string"), attack, defence, venue).first()
    assert new["mu"] > 0


def weekly_fit_plainly(rows: pd.DataFrame, week: int, x: list[str]) -> dict:
    """One week of the full fit on the driver: fills, factors, Poisson optimum and league ratios of all earlier weeks."""
    ok = rows[rows.shots.notna() & (rows.shots >= 0)]
    past, now = ok[ok.week < week], ok[ok.week == week]
    by_league, overall = past.groupby("league").opp_elo.mean(), past.opp_elo.mean() if past.opp_elo.notna().any() else 1500.0
    tr = past[past.gf.notna()]

    def numbers(df):
        ref = df.league.map(by_league).fillna(overall)
        z = [df[c].fillna(tr[c].median() if tr[c].notna().any() else {"corners": 4.0}.get(c, 0.0)) for c in x]
        return np.column_stack([*z, (df.opp_elo / ref).clip(0.8, 1.2).fillna(1.0)])

    out = {"factor": dict(zip(zip(now.fixture_id, now.venue), numbers(now)[:, -1]))} if len(now) else {}
    if len(tr) < 30:
        mean = tr.groupby("venue").gf.mean()
        return out | {"xg": {(r.fixture_id, r.venue): mean.get(r.venue, 1.25) for r in now.itertuples()}, "cal": {}}
    a, y = numbers(tr), tr.gf.to_numpy(float)
    m, sd = a.mean(0), np.where(a.std(0) > 1e-6, a.std(0), 1.0)
    z, b, pen = np.column_stack([np.ones(len(a)), (a - m) / sd]), np.zeros(a.shape[1] + 1), np.diag([0.0] + [0.1] * a.shape[1])
    b[0] = math.log(y.mean())
    for _ in range(60):
        mu = np.exp(z @ b)
        b = b - np.linalg.solve((z * mu[:, None]).T @ z / len(y) + pen, z.T @ (mu - y) / len(y) + pen @ b)
    mu, cal = np.exp(z @ b), {}
    for lg in tr.league.unique():
        at = (tr.league == lg).to_numpy()
        if at.sum() >= 20:
            cal[lg] = min(max(1 + at.sum() / (at.sum() + 80) * (y[at].mean() / mu[at].mean() - 1), 0.85), 1.15)
    raw = np.exp(np.column_stack([np.ones(len(now)), (numbers(now) - m) / sd]) @ b) if len(now) else []
    return out | {"xg": {(r.fixture_id, r.venue): v * cal.get(r.league, 1.0) for r, v in zip(now.itertuples(), raw)}, "cal": cal}


def weekly_rows(spark, n=240):
    rnd, out = np.random.default_rng(4), []
    for i in range(n):
        for venue in ("home", "away"):
            shots = None if i % 17 == 0 and venue == "home" else -1.0 if i % 19 == 0 else float(rnd.integers(3, 20))
            corners = None if i < 30 or rnd.random() < 0.3 else float(rnd.integers(0, 9)) / (1 + i % 3)
            gf = None if i % 13 == 0 else int(rnd.poisson(1.4))
            # league A holds most rows, C comes late, D has no rating
            lg = "D" if i % 11 == 0 else "B" if i % 5 == 0 else "C" if i > 200 else "A"
            elo = None if lg == "D" or rnd.random() < 0.1 else float(rnd.integers(1000, 2000) + (400 if lg == "B" else 0))
            out.append((i, venue, lg, i // 12 + 100, shots, corners, elo, gf))
    return spark.createDataFrame(out, "fixture_id long, venue string, league string, week long, shots double, corners double, opp_elo double, gf int")


def test_weekly_fits_with_gaps_factors_and_league_ratios(spark, monkeypatch):
    monkeypatch.setattr(xg, "BLOCK_ROWS", 40)
    monkeypatch.setattr(xg, "STEP", 16)
    df = weekly_rows(spark)
    made = xg.weekly_fits(df, ["shots", "corners"], required=["shots"], opponent="opp_elo", calibration=xg.Calibration(min_rows=20), defaults={"corners": 4.0})
    rows = df.toPandas()
    got = {(r["fixture_id"], r["venue"]): r for r in made.xg.collect()}
    assert len(got) == len(rows) == made.xg.count()  # rows that can't be learnt from stay, without xg
    fills = {r["week"]: r["fill"] for r in made.fills.where("feature = 'corners'").collect()}
    ratios = {(r["league"], r["week"]): r["multiplier"] for r in made.calibration.collect()}
    assert any(v is not None for v in ratios.values()) and all(abs(r["score"]) < 1e-6 for r in made.fits.collect())
    for week in sorted(rows.week.unique()):
        want = weekly_fit_plainly(rows, week, ["shots", "corners"])
        for k, v in want["xg"].items():
            assert abs(got[k]["xg"] - v) < 1e-6 and abs(got[k]["factor"] - want["factor"][k]) < 1e-12
        assert {lg: round(m, 8) for (lg, w), m in ratios.items() if w == week and m is not None} == {lg: round(m, 8) for lg, m in want["cal"].items()}
        tr = rows[(rows.week < week) & (rows.shots >= 0) & rows.gf.notna()].corners
        assert abs(fills[week] - (tr.median() if tr.notna().any() else 4.0)) < 1e-12
    bad = rows[~(rows.shots >= 0)]
    assert len(bad) > 10 and all(got[(r.fixture_id, r.venue)]["xg"] is None for r in bad.itertuples())


def test_weekly_fits_of_empty_and_unusable_tables(spark):
    df = weekly_rows(spark, 4)
    assert xg.weekly_fits(df.limit(0), ["shots", "corners"], opponent="opp_elo", calibration=xg.Calibration()).xg.count() == 0
    none = xg.weekly_fits(df.withColumn("week", F.lit(None).cast("long")), ["shots"], calibration=xg.Calibration())
    assert [r["xg"] for r in none.xg.collect()] == [None] * 8 and none.calibration.count() == 0


def test_medians_before_are_exact(spark):
    rnd = np.random.default_rng(9)
    rows = pd.DataFrame({"at": rnd.integers(0, 12, 3000), "a": rnd.normal(size=3000), "b": rnd.integers(0, 3, 3000).astype(float)})
    rows.loc[rows["at"] < 3, "a"] = np.nan
    rows.loc[rnd.random(3000) < 0.2, "b"] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in rows.astype(object).itertuples(index=False)], "at int, a double, b double")
    for bins in (2, 16, 256):
        got = {(r["feature"], r["step"]): r["median"] for r in xg.medians_before(df, ["a", "b"], "at", 12, bins).collect()}
        want = {(c, s): rows[rows["at"] < s][c].median() for c in "ab" for s in range(12)}
        want = {k: v for k, v in want.items() if v == v}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)

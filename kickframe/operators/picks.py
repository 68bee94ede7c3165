"""Candidates, gates, selection with quota, stakes and settlement-ready picks.

Fixture-level facts are computed once per fixture, then one row per market is generated next to them, so
gates and scores are plain column expressions without a shuffle. The best market per fixture and the quota
per round are the only exchanges.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kickframe import config
from kickframe.functions.cols import is_true, reasons

MARKETS = ["OU25_OVER", "OU25_UNDER", "BTTS_YES", "BTTS_NO"]


@dataclass(frozen=True)
class PickRules:
    """Selection parameters; per-league maps override the defaults."""

    mu_total: tuple[float, float] = (1.6, 3.4)
    odds_min: float = 1.70
    min_prob: float = 0.52
    priced_bonus: float = 0.08
    low_scoring_mu: float = 2.3
    low_scoring_bonus: float = 0.04
    evidence_default: tuple[float, float, float] = config.EVIDENCE_DEFAULT
    evidence_fallback: tuple[float, float, float] = config.EVIDENCE_FALLBACK
    evidence_primary: dict = field(default_factory=lambda: config.EVIDENCE_PRIMARY)
    raw_score_leagues: tuple = tuple(config.RAW_SCORE_LEAGUES)
    blocked: dict = field(default_factory=lambda: config.BLOCKED_MARKETS)
    tier_bonus: dict = field(default_factory=lambda: config.TIER_BONUS)
    market_bonus: dict = field(default_factory=lambda: config.MARKET_BONUS)
    btts_source: str = "independent"
    calibration: dict = field(default_factory=dict)
    quota: int = 5
    target: int = 4


def _by_league(values: dict, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for league, v in values.items():
        out = out.when(F.col("league") == league, F.lit(v))
    return out.otherwise(F.lit(default))


def _evidence_gaps(gate: tuple[Column, Column, Column]) -> list[tuple[Column, str]]:
    names = [("neff_min", "NEFF"), ("press_n_min", "PRESS_EVIDENCE"), ("xg_n_min", "XG_EVIDENCE")]
    return [(~is_true(F.col(c) >= g), f"G3_FAIL_LOW_{label}") for (c, label), g in zip(names, gate)]


def _low_of(a: str, b: str) -> Column:
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.least(a, b))


def low_scoring(rules: PickRules) -> Column:
    """At least two of four signs that few goals will fall."""
    signs = [
        F.col("mu_total") < rules.low_scoring_mu,
        (F.col("mu_home") < 1.2) & (F.col("mu_away") < 1.2),
        F.col("sterile") > 0,
        F.col("p_under") > 0.52,
    ]
    return sum((is_true(s).cast("int") for s in signs), F.lit(0)) >= 2


def candidates(preds: DataFrame, rules: PickRules, keep: list[str]) -> DataFrame:
    """One row per fixture and market with probability, price, gate tier, reasons, score and eligibility."""
    df = preds.withColumns(
        {
            "neff_min": _low_of("neff_h", "neff_a"),
            "press_n_min": _low_of("press_n_h", "press_n_a"),
            "xg_n_min": _low_of("xg_n_h", "xg_n_a"),
            "low_scoring": low_scoring(rules).cast("int"),
        }
    )
    primary = tuple(_by_league({lg: g[i] for lg, g in rules.evidence_primary.items()}, rules.evidence_default[i]) for i in range(3))
    fallback = tuple(F.lit(x) for x in rules.evidence_fallback)
    strong = F.lit(True)
    for missing, _ in _evidence_gaps(primary):
        strong = strong & ~missing
    df = df.withColumn("gate_tier", F.when(strong, "primary").otherwise("fallback"))
    positive = lambda c: F.greatest(F.col(c), F.lit(0.0))
    tier = F.lit(0.0)
    for (league, name), bonus in rules.tier_bonus.items():
        tier = tier + F.when((F.col("league") == league) & (F.col("gate_tier") == name), bonus).otherwise(0.0)
    independent = (1 - F.exp(-F.col("mu_home"))) * (1 - F.exp(-F.col("mu_away")))
    df = df.withColumns(
        {
            "_evid": 0.01 * F.log(1.0 + positive("neff_min")) + 0.005 * (positive("press_n_min") + positive("xg_n_min")) + tier,
            "_yes": F.col("p_btts_joint") if rules.btts_source == "joint" else independent,
        }
    )
    facts = ["neff_min", "press_n_min", "xg_n_min", "low_scoring", "gate_tier"]
    needed = ["league", "mu_total", "p_over", "p_under", "odds_over", "odds_under", "odds_yes", "odds_no", "_evid", "_yes"]
    columns = list(dict.fromkeys([*keep, *facts, *needed]))
    rows = df.select(*columns, F.posexplode(F.array(*[F.lit(m) for m in MARKETS])).alias("market_rank", "market"))

    m = F.col("market")
    by_market = lambda over, under, yes, no: F.when(m == "OU25_OVER", over).when(m == "OU25_UNDER", under).when(m == "BTTS_YES", yes).otherwise(no)
    c = F.col
    rows = rows.withColumns(
        {
            "p_model": by_market(c("p_over"), c("p_under"), c("_yes"), 1 - c("_yes")),
            "odds": by_market(c("odds_over"), c("odds_under"), c("odds_yes"), c("odds_no")),
        }
    )
    lo, hi = rules.mu_total
    p, o, total = c("p_model"), c("odds"), c("mu_total")
    blocked = F.lit(False)
    for league, names in rules.blocked.items():
        blocked = blocked | ((c("league") == league) & m.isin(list(names)))
    limits = {i: _by_league({lg: x[i] for lg, x in rules.calibration.items()}, None).cast("double") for i in (0, 1)}
    calibrated = [
        ((m == "OU25_OVER") & (p < limits[0]), "G6_FAIL_CALIB_OU25_OVER"),
        ((m == "BTTS_YES") & (p < limits[1]), "G6_FAIL_CALIB_BTTS_YES"),
        ((m == "BTTS_NO") & (1 - p > limits[1]), "G6_FAIL_CALIB_BTTS_NO"),
    ]
    weak = c("gate_tier") == "fallback"
    # in alphabetical order, the order reasons are reported in
    gates = [
        (o <= rules.odds_min, "G1_FAIL_LOW_ODDS"),
        (~is_true(total <= hi) & ~is_true(total < lo), "G2_FAIL_HIGH_MU_TOTAL"),
        (total < lo, "G2_FAIL_LOW_MU_TOTAL"),
        *[(weak & gap, label) for gap, label in _evidence_gaps(fallback)],
        (~is_true(p > rules.min_prob), "G5_FAIL_LOW_MODEL_PROB"),
        *(calibrated if rules.calibration else []),
        (blocked, "G7_FAIL_LEAGUE_MARKET_BLOCKED"),
    ]
    bonus = F.when((m == "OU25_UNDER") & (c("low_scoring") == 1), rules.low_scoring_bonus).otherwise(0.0)
    for (league, name), b in rules.market_bonus.items():
        bonus = bonus + F.when((c("league") == league) & (m == name), b).otherwise(0.0)
    edge = F.greatest(F.coalesce(p, F.lit(0.5)) - 0.5, F.lit(0.0)) * 2.0
    score = edge + c("_evid") + bonus + F.when(o > rules.odds_min, rules.priced_bonus).otherwise(0.0)
    any_gate = F.lit(False)
    for cond, _ in gates:
        any_gate = any_gate | is_true(cond)
    rows = rows.withColumns(
        {
            "ev": p * o - 1,
            "score": F.round(score, 10),
            "eligible": ~any_gate,
            "reasons": F.concat_ws("|", *[F.when(cond, F.lit(label)) for cond, label in gates]),
        }
    )
    out = list(dict.fromkeys([*keep, *facts, "league"]))
    return rows.select(*out, "market", "market_rank", "odds", "p_model", "ev", "score", "eligible", "reasons")


def _sort_key(rules: PickRules, score: Column, p: Column, tier: Column, neff: Column, rank: Column, market: Column) -> Column:
    """Struct whose minimum is the best candidate; leagues may rank by raw score before the gate tier."""
    gate = F.when(tier == "primary", 0).otherwise(1)
    raw = F.col("league").isin(list(rules.raw_score_leagues)) if rules.raw_score_leagues else F.lit(False)
    lead = F.when(raw, 0).otherwise(gate)
    return F.struct(
        lead.alias("a"), (-score).alias("b"), (-F.round(p, 10)).alias("c"), gate.alias("d"), (-neff).alias("e"), rank.alias("f"), market.alias("g")
    )


def select_picks(preds: DataFrame, rules: PickRules, round_keys: list[str], keep: list[str]) -> DataFrame:
    """Best eligible candidate per fixture, then the quota per round with confidence, stake and flags.

    First-tier picks fill the quota alone once there are ``target`` of them.
    """
    rows = candidates(preds, rules, list(dict.fromkeys(["fixture_id", *round_keys, *keep]))).filter("eligible").drop("eligible", "reasons")
    key = _sort_key(rules, *[F.col(c) for c in ("score", "p_model", "gate_tier", "neff_min", "market_rank", "market")])
    # the rows of a fixture sit in one partition, so the partial aggregate already leaves one of them
    best = rows.groupBy("fixture_id").agg(F.min(F.struct(key.alias("k"), F.struct(*[c for c in rows.columns if c != "fixture_id"]).alias("c"))).alias("_b"))
    top = best.select("fixture_id", F.col("_b.k").alias("_k"), "_b.c.*")
    w = W.partitionBy(*round_keys).orderBy("_k", "fixture_id")
    ranked = top.withColumn("pick_rank", F.row_number().over(w)).filter(F.col("pick_rank") <= rules.quota)
    # first-tier rows sort first, so counting them among the few kept rows is enough
    n_first = F.count_if(F.col("gate_tier") == "primary").over(W.partitionBy(*round_keys))
    ranked = ranked.withColumn("_first", n_first)
    raw = F.col("league").isin(list(rules.raw_score_leagues)) if rules.raw_score_leagues else F.lit(False)
    chosen = ranked.filter(raw | (F.col("gate_tier") == "primary") | (F.col("_first") < rules.target))
    return with_stakes(chosen.drop("_k", "_first"))


def with_stakes(picks: DataFrame) -> DataFrame:
    """Confidence from edge, evidence and risk; stake tier and flag text."""
    part = lambda c, full: F.least(F.col(c) / full, F.lit(1.0))
    rel = part("neff_min", 10.0) * part("press_n_min", 5.0) * part("xg_n_min", 5.0)
    penalty = F.when((F.col("sterile") > 0) | (F.col("assassin") > 0), 0.85).otherwise(1.0)
    conf = F.greatest(F.lit(0.0), F.coalesce(F.col("p_model") - 0.5, F.lit(0.0))) * rel * penalty
    picks = picks.withColumn("confidence", conf)
    c = F.round("confidence", 10)
    tier = F.when(c < 0.05, "T1").when(c < 0.09, "T2").when(c < 0.13, "T3").otherwise("T4")
    units = F.when(c < 0.05, 0.5).when(c < 0.09, 1.0).when(c < 0.13, 1.5).otherwise(2.0)
    implied = F.when(F.col("odds") > 0, 1.0 / F.col("odds"))
    flags = reasons(
        (F.col("sterile") > 0, "STERILE"), (F.col("assassin") > 0, "ASSASSIN"), (F.col("slow_start") > 0, "SLOW_START"), (F.col("late_goal") > 0, "LATE_GOALS")
    )
    return picks.withColumns(
        {"stake_tier": tier, "stake_units": units, "value_margin": F.col("p_model") - implied, "risk_flags": F.array_join(flags, "|")}
    )


def full_market_picks(preds: DataFrame, markets: dict[str, tuple[Column, Column, str]], rules: dict) -> DataFrame:
    """Best priced market per fixture over 1X2 and totals with strict gates.

    ``markets[name] = (probability, odds, group)``; a group needs all its prices. Sterile fixtures block the
    over, assassin fixtures raise the EV needed.
    """
    low = lambda a, b: F.least(F.col(a), F.col(b))
    base = [
        (is_true(F.col("mu_total") < rules["mu"][0]), "G2_FAIL_LOW_MU_TOTAL"),
        (~is_true(F.col("mu_total") <= rules["mu"][1]) & ~is_true(F.col("mu_total") < rules["mu"][0]), "G2_FAIL_HIGH_MU_TOTAL"),
        (~is_true(low("neff_h", "neff_a") >= rules["neff"]), "G3_FAIL_LOW_NEFF"),
        (~is_true(low("press_n_h", "press_n_a") >= rules["press"]), "G3_FAIL_LOW_PRESS_EVIDENCE"),
        (~is_true(low("xg_n_h", "xg_n_a") >= rules["xg"]), "G3_FAIL_LOW_XG_EVIDENCE"),
    ]
    sane = {}
    for _, o, g in markets.values():
        sane[g] = sane.get(g, F.lit(True)) & is_true(o > rules["odds_min"])

    def one(name: str, rank: int) -> Column:
        p, o, g = markets[name]
        need = F.when((F.col("assassin") > 0), rules["ev_assassin"]).otherwise(rules["ev"])
        why = reasons(*base, (~sane[g], f"G1_FAIL_MISSING_ODDS_{g}"), ((F.col("sterile") > 0) & F.lit(name == "OU25_OVER"), "G4_BLOCK_OU_STERILE"), (~is_true(p * o - 1 >= need), "G5_FAIL_LOW_EV"))
        return F.struct((-F.round(p * o - 1, 10)).alias("k"), F.lit(rank).alias("r"), F.lit(name).alias("market"), p.alias("p_model"), o.alias("odds"), (F.size(why) == 0).alias("ok"))

    df = preds.withColumn("_c", F.array(*[one(m, i) for i, m in enumerate(markets)]))
    best = df.withColumn("_b", F.array_min(F.filter("_c", lambda c: c["ok"]))).filter("_b IS NOT NULL")
    return best.select("fixture_id", "_b.market", "_b.p_model", "_b.odds", (-F.col("_b.k")).alias("ev"))


# ---------------------------------------------------------------- rule strategies over a valued book

# Each gives the condition on a book row; ``_fav`` is the largest 1X2 probability of the row's fixture.


def strategy_favourite(min_prob: float = 0.52, min_edge: float = 0.01, min_odds: float = 1.6, gap: float = 40.0) -> Column:
    lead = F.when(F.col("outcome") == "H", F.col("elo_home") - F.col("elo_away")).when(F.col("outcome") == "A", F.col("elo_away") - F.col("elo_home"))
    return (F.col("market") == "1X2") & (lead >= gap) & _worth(min_prob, min_edge, min_odds)


def strategy_totals(line: str = "2.5", min_prob: float = 0.57, min_edge: float = 0.01, min_odds: float = 1.6) -> Column:
    return (F.col("market") == f"OU {line}") & _worth(min_prob, min_edge, min_odds)


def strategy_interval(min_prob: float = 0.40, min_edge: float = 0.03, min_odds: float = 1.6) -> Column:
    return (F.col("market") == "TG Interval") & _worth(min_prob, min_edge, min_odds)


def strategy_underdog(max_fav: float = 0.6, min_edge: float = 0.01, min_odds: float = 1.4) -> Column:
    """Double chance where no outcome is a strong favourite."""
    return (F.col("market") == "DC") & (F.col("_fav") <= max_fav) & (F.col("edge") >= min_edge) & (F.col("odds") >= min_odds)


def _worth(min_prob: float, min_edge: float, min_odds: float) -> Column:
    return (F.col("prob") >= min_prob) & (F.col("edge") >= min_edge) & (F.col("odds") >= min_odds)


# registry of row rules, all tried in one pass over the book
STRATEGIES = {
    "favourite": strategy_favourite,
    "totals": strategy_totals,
    "interval": strategy_interval,
    "underdog": strategy_underdog,
}


def run_strategies(book: DataFrame, names: list[str]) -> DataFrame:
    """Book rows that a chosen strategy takes, once per strategy and tagged with it; the book is worked out once."""
    fixture = F.col("fixture_id").isNotNull()
    fav = F.max(F.when((F.col("market") == "1X2") & fixture, F.col("prob"))).over(W.partitionBy("fixture_id"))
    rules = {n: STRATEGIES[n]() for n in names}
    met = F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]))
    # only 1X2 rows and those that nothing but the favourite can rule out are sorted by fixture
    maybe = reduce(lambda a, b: a | b, [~rule.eqNullSafe(F.lit(False)) for rule in rules.values()], F.col("market") == "1X2")
    book = book.withColumn("_fav", F.lit(None).cast("double")).where(maybe).drop("_fav")
    return book.withColumn("_fav", fav).withColumn("strategy", F.explode(met)).drop("_fav")


def stakes(bets: DataFrame, bankroll: float = 1000.0, flat: float = 10.0, kelly: float = 0.25, min_mult: float = 0.4) -> DataFrame:
    """Flat and fractional-Kelly stakes on a fixed bankroll, throttled by the number of bets per day and market."""
    sized = bets.groupBy("day", "market").agg(F.count(F.lit(1)).alias("_n"))
    df = bets.join(sized, ["day", "market"])
    mult = F.greatest(F.lit(min_mult), 1.0 / F.sqrt("_n"))
    f = (F.col("p") * F.col("odds") - (1 - F.col("p"))) / F.greatest(F.col("odds") - 1, F.lit(1e-9))
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))
    return df.withColumns({"stake_flat": flat * mult, "stake_kelly": F.lit(bankroll * kelly) * f * mult}).drop("_n")

"""Score grids, market probabilities, prices and value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kickframe.functions.cols import clamp, col
from kickframe.functions.grids import independent_grid, mixed_grid, shortest_span


def p_under_25(mu_total: Column | str) -> Column:
    """P(total <= 2) for a Poisson total; null for a missing or negative mean."""
    m = col(mu_total)
    return F.when(m >= 0, clamp(F.exp(-m) * (1 + m + m * m / 2.0), 0.0, 1.0))


def p_btts(mu_home: Column | str, mu_away: Column | str) -> Column:
    """P(both score) for independent Poisson counts."""
    h, a = col(mu_home), col(mu_away)
    return F.when((h >= 0) & (a >= 0), clamp((1 - F.exp(-h)) * (1 - F.exp(-a)), 0.0, 1.0))


# ---------------------------------------------------------------- score grid

GRID = 12


def poisson_p(mu: Column | str, k: Column | int) -> Column:
    """P(k) of a Poisson count."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.exp(-col(mu)) * F.pow(col(mu), k) / F.factorial(k.cast("int"))


def grid_size(mu_h: Column, mu_a: Column, floor: int = 10, cap: int = 14) -> Column:
    """Goals per side a grid must reach for the given means."""
    total = F.greatest(F.lit(0.01), mu_h + mu_a)
    return clamp(F.ceil(total + 6.0 * F.sqrt(total + 1.0)), floor, cap).cast("int")


def market_probs(
    df: DataFrame, mu_h: str, mu_a: str, dep: Column, alpha: Column, rho: Column, n: Column | int = GRID
) -> DataFrame:
    """1X2, over/under 2.5 and both-score probabilities of the mixed, dependent, low-score corrected grid.

    Columns ``p_home, p_draw, p_away, p_over25, p_under25, p_btts_yes, p_btts_no``.
    """
    size = n if isinstance(n, Column) else F.lit(n)
    g = mixed_grid(F.col(mu_h), F.col(mu_a), dep, alpha, rho, size)
    c = F.col
    return (
        df.withColumn("_g", g)
        .withColumns(
            {
                "p_home": c("_g.home"),
                "p_draw": c("_g.draw"),
                "p_away": 1.0 - c("_g.home") - c("_g.draw"),
                "p_over25": 1.0 - c("_g.under25"),
                "p_under25": c("_g.under25"),
                "p_btts_yes": c("_g.btts"),
                "p_btts_no": 1.0 - c("_g.btts"),
            }
        )
        .drop("_g")
    )


def score_cells(df: DataFrame, mu_h: str, mu_a: str, keep: list[str], n: int = 10, trim: float = 0.0) -> DataFrame:
    """Long cells ``x, y, p`` of the normalised independent grid, cells below ``trim`` removed and the rest rescaled."""
    side = F.sequence(F.lit(0), F.lit(n))
    df = df.withColumn("_s", independent_grid(F.col(mu_h), F.col(mu_a), n, trim))
    cells = df.withColumn("x", F.explode(side)).withColumn("y", F.explode(side))
    p = poisson_p(mu_h, F.col("x")) * poisson_p(mu_a, F.col("y")) / F.col("_s.mass")
    return cells.withColumn("_p", p).filter(F.col("_p") >= trim).select(*keep, "x", "y", (F.col("_p") / F.col("_s.kept")).alias("p"))


Row = tuple[str, str, Column]
LINES, INTERVALS = (1.5, 2.5, 3.5), ((0, 1), (1, 3), (2, 4), (3, 6))


def book_rows(df: DataFrame, mu_h: str, mu_a: str, lines: Sequence[float] = LINES, intervals: Sequence[tuple[int, int]] = INTERVALS, n: int = 10) -> tuple[DataFrame, list[Row]]:
    """``df`` with the grid sums ``_s``, and (market, outcome, probability) of the book over them: 1X2, double chance, totals, intervals."""
    df = df.withColumn("_s", independent_grid(F.col(mu_h), F.col(mu_a), n))
    h, d = F.col("_s.home"), F.col("_s.draw")
    a = 1.0 - h - d
    upto = lambda lo, hi: sum((F.get("_s.totals", F.lit(i)) for i in range(lo, hi + 1)), F.lit(0.0))
    rows = [("1X2", "H", h), ("1X2", "D", d), ("1X2", "A", a), ("DC", "1X", h + d), ("DC", "12", h + a), ("DC", "X2", d + a)]
    for line in lines:
        under = upto(0, int(line))
        rows += [(f"OU {line}", "Under", under), (f"OU {line}", "Over", 1.0 - under)]
    return df, rows + [("TG Interval", f"{lo}-{hi}", upto(lo, hi)) for lo, hi in intervals]


def market_book(df: DataFrame, mu_h: str, mu_a: str, keep: list[str], lines: Sequence[float] = LINES, intervals: Sequence[tuple[int, int]] = INTERVALS, n: int = 10) -> DataFrame:
    """Flat book ``market, outcome, prob`` from an independent grid."""
    df, rows = book_rows(df, mu_h, mu_a, lines, intervals, n)
    structs = [F.struct(F.lit(m).alias("market"), F.lit(o).alias("outcome"), p.alias("prob")) for m, o, p in rows]
    return df.select(*keep, F.inline(F.array(*structs)))


def valued_book(df: DataFrame, mu_h: str, mu_a: str, keep: list[str], price: Callable[[str, str, Column], Column], margin: float | None = None) -> DataFrame:
    """The flat book with prices, edge and EV of :func:`value_book`, from one grid pass and without a shuffle.

    The outcomes of a market are columns of one row, so its sums are additions; ``price(market, outcome, prob)`` gives the
    price or null.
    """
    margin = DEFAULT_MARGIN if margin is None else margin
    df, rows = book_rows(df, mu_h, mu_a)
    df = df.withColumns({f"_p{i}": p for i, (_, _, p) in enumerate(rows)})
    df = df.withColumns({f"_o{i}": price(m, o, F.col(f"_p{i}")) for i, (m, o, _) in enumerate(rows)})
    same = {m: [i for i, r in enumerate(rows) if r[0] == m] for m, _, _ in rows}
    total = {m: sum((F.col(f"_p{i}") for i in own), F.lit(0.0)) for m, own in same.items()}
    paid = {}
    for i, (m, _, _) in enumerate(rows):
        fair = F.when(total[m] > 0, F.col(f"_p{i}") / total[m]).otherwise(1.0 / len(same[m]))
        paid[f"_c{i}"] = F.greatest(F.coalesce(F.col(f"_o{i}"), 1.0 / F.greatest(fair * (1.0 + margin), F.lit(1e-6))), F.lit(1.01))
    df = df.withColumns(paid)
    structs = []
    for i, (m, o, _) in enumerate(rows):
        prob, odds = F.col(f"_p{i}"), F.col(f"_c{i}")
        norm = (1.0 / odds) / sum((1.0 / F.col(f"_c{j}") for j in same[m]), F.lit(0.0))
        real = F.col(f"_o{i}").isNotNull()
        structs.append(
            F.struct(
                F.lit(m).alias("market"), F.lit(o).alias("outcome"), prob.alias("prob"), odds.alias("odds"), F.when(real, "real").otherwise("synth").alias("price_source"), (1.0 / odds).alias("p_imp"),
                (1.0 / F.greatest(prob, F.lit(1e-9))).alias("fair_odds"), norm.alias("p_imp_norm"), (prob - norm).alias("edge"), F.when(real, expected_value(prob, odds)).alias("ev"),
            )
        )
    return df.select(*keep, F.inline(F.array(*structs)))


def shortest_interval(df: DataFrame, mu_h: str, mu_a: str, level: float, n: int = 10) -> DataFrame:
    """Adds ``span``: the narrowest total-goals interval ``a-b`` holding at least ``level``."""
    df = df.withColumn("_s", independent_grid(F.col(mu_h), F.col(mu_a), n)).withColumn("_b", shortest_span(F.col("_s.totals"), level))
    span = F.concat_ws("-", F.col("_b.start").cast("string"), F.col("_b.end").cast("string"))
    return df.withColumn("span", span).drop("_s", "_b")


# ---------------------------------------------------------------- prices and value

# Stand-in prices per market, margins used to price a book that has none.
PLACEHOLDER_ODDS = {"1X2": 2.0, "DC": 1.33, "TG Interval": 3.0}
DEFAULT_MARGIN = 0.06


def implied(*odds: Column | str) -> list[Column]:
    """Implied probabilities of one market with the overround removed; missing prices stay missing."""
    inv = [F.when(col(o) > 0, 1.0 / col(o)) for o in odds]
    total = sum((F.coalesce(i, F.lit(0.0)) for i in inv), F.lit(0.0))
    return [F.try_divide(i, total) for i in inv]


def expected_value(p: Column | str, odds: Column | str) -> Column:
    return col(p) * col(odds) - 1


def placeholder_odds(market: Column) -> Column:
    out = F.when(market.startswith("OU "), F.lit(2.0))
    for m, o in PLACEHOLDER_ODDS.items():
        out = out.when(market == m, F.lit(o))
    return out.otherwise(F.lit(2.0))


def value_book(book: DataFrame, keys: list[str], margin: float = DEFAULT_MARGIN, placeholders: bool = False) -> DataFrame:
    """Fair odds, synthetic prices where missing, normalised implied probability, edge and EV.

    Needs ``market, outcome, prob, odds``, one row per key, market and outcome (dedupe first), so a market's
    window holds at most its outcomes. EV is missing for synthetic prices.
    """
    if placeholders:
        book = book.withColumn("odds", placeholder_odds(F.col("market")))
    grp = W.partitionBy(*keys, "market")
    df = book.withColumns({"_sp": F.sum("prob").over(grp), "_k": F.count(F.lit(1)).over(grp)})
    fair = F.when(F.col("_sp") > 0, F.col("prob") / F.col("_sp")).otherwise(1.0 / F.col("_k"))
    synth = 1.0 / F.greatest(fair * (1.0 + margin), F.lit(1e-6))
    odds = F.greatest(F.coalesce("odds", synth), F.lit(1.01))
    df = df.withColumns({"price_source": F.when(F.col("odds").isNull(), "synth").otherwise("real"), "odds": odds})
    df = df.withColumn("p_imp", 1.0 / F.col("odds"))
    df = df.withColumn("_si", F.sum("p_imp").over(grp))
    return df.withColumns(
        {
            "fair_odds": 1.0 / F.greatest("prob", F.lit(1e-9)),
            "p_imp_norm": F.col("p_imp") / F.col("_si"),
            "edge": F.col("prob") - F.col("p_imp") / F.col("_si"),
            "ev": F.when(F.col("price_source") == "real", expected_value("prob", "odds")),
        }
    ).drop("_sp", "_k", "_si")


def blend(a: Column | str, b: Column | str, weight: float) -> Column:
    """(1-w) a + w b, or a where b is missing."""
    a, b = col(a), col(b)
    return F.coalesce((1.0 - weight) * a + weight * b, a)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def fuse_signal(p_model: Column, strength_gap: Column, elo_gap: Column, w: dict[str, float]) -> Column:
    """Model probability fused with a bounded form and rating signal."""
    bias = w["form"] * sigmoid(w["slope_strength"] * strength_gap) + w["elo"] * F.coalesce(
        sigmoid(w["slope_elo"] * (elo_gap / 200.0)), F.lit(0.5)
    )
    return clamp(w["model"] * p_model + w["signal"] * bias, 0.0, 1.0)


# ---------------------------------------------------------------- expected counts


def anchor(value: Column | str, default: float, limits: tuple[float, float]) -> Column:
    return clamp(F.coalesce(col(value), F.lit(default)), *limits)


def blended_means(df: DataFrame, weights: dict[str, float], limits: dict) -> DataFrame:
    """Expected goals of both sides from league anchor, rating, xG and pressure modules.

    Uses ``lg_home, lg_away`` (anchors), ``sim_gf_h, sim_ga_h, sim_gf_a, sim_ga_a`` (similar opponents),
    ``xg_for_h, xg_against_h, xg_for_a, xg_against_a, xg_usable``, ``press_h, press_a, pressure_usable`` and
    any ``dom_*_h`` / ``dom_*_a`` columns. Adds ``mu_home, mu_away``, the module values and ``neutralised``.
    """
    from kickframe.functions.cols import mean_present

    c = F.col
    goals = limits["goals"]
    total_w = sum(max(v, 0.0) for v in weights.values())
    w = {k: max(v, 0.0) / total_w for k, v in weights.items()}
    df = df.withColumns(
        {
            "anchor_home": anchor("lg_home", limits["anchor_home"], goals),
            "anchor_away": anchor("lg_away", limits["anchor_away"], goals),
        }
    )
    ah, aa = c("anchor_home"), c("anchor_away")
    any_of = lambda names: F.coalesce(*[c(n) for n in names]).isNotNull()
    sims, xgs = ["sim_gf_h", "sim_ga_h", "sim_gf_a", "sim_ga_a"], ["xg_for_h", "xg_against_h", "xg_for_a", "xg_against_a"]
    xg_ok = F.coalesce(c("xg_usable") > 0, F.lit(False))
    press_ok = F.coalesce(c("pressure_usable") > 0, F.lit(False))
    ph, pa = F.coalesce("press_h", F.lit(0.5)), F.coalesce("press_a", F.lit(0.5))
    attack_h, attack_a = (ph + (1 - pa)) / 2.0, (pa + (1 - ph)) / 2.0
    anchor_total = F.greatest(ah + aa, F.lit(goals[0] * 2.0))
    share = F.when(attack_h + attack_a > 0, attack_h / (attack_h + attack_a)).otherwise(ah / anchor_total)
    share = clamp(share, *limits["share"])
    dom = lambda s: [x for x in df.columns if x.startswith("dom_") and x.endswith(f"_{s}")]
    tempo = (mean_present(ph, *dom("h")) + mean_present(pa, *dom("a"))) / 2.0
    module_total = anchor_total * clamp(1.0 + limits["strength"] * (tempo - 0.5), *limits["total"])
    df = df.withColumns(
        {
            "mu_rating_home": clamp(F.coalesce(mean_present("sim_gf_h", "sim_ga_a"), ah), *goals),
            "mu_rating_away": clamp(F.coalesce(mean_present("sim_gf_a", "sim_ga_h"), aa), *goals),
            "mu_xg_home": F.when(xg_ok, clamp(F.coalesce(mean_present("xg_for_h", "xg_against_a"), ah), *goals)).otherwise(ah),
            "mu_xg_away": F.when(xg_ok, clamp(F.coalesce(mean_present("xg_for_a", "xg_against_h"), aa), *goals)).otherwise(aa),
            "mu_pressure_home": F.when(press_ok, clamp(module_total * share, *goals)).otherwise(ah),
            "mu_pressure_away": F.when(press_ok, clamp(module_total * (1.0 - share), *goals)).otherwise(aa),
            "neutralised": F.array_join(
                F.array_compact(
                    F.array(
                        F.when(~any_of(sims), "elo"), F.when(~(xg_ok & any_of(xgs)), "xg"), F.when(~press_ok, "pressure")
                    )
                ),
                "|",
            ),
        }
    )
    mix = lambda s: clamp(
        w["anchor"] * c(f"anchor_{s}") + w["rating"] * c(f"mu_rating_{s}") + w["xg"] * c(f"mu_xg_{s}") + w["pressure"] * c(f"mu_pressure_{s}"),
        *goals,
    )
    return df.withColumns({"mu_home": mix("home"), "mu_away": mix("away")})


def timing_rates(df: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Goal intensity by period from two team profiles, shares, flags and the chance of late goals.

    Needs ``mu_home, mu_away`` and arrays ``sc_h, co_h, sc_a, co_a`` (six shares each), ``prior_early``,
    ``prior_late``.
    """
    mh, ma = F.col("mu_home"), F.col("mu_away")
    half = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2.0)
    df = df.withColumns({"_h": half("sc_h", "co_a"), "_a": half("sc_a", "co_h")})
    df = df.withColumn("_lam", F.zip_with("_h", "_a", lambda x, y: mh * x + ma * y))
    lam = lambda i: F.get("_lam", i)
    total = mh + ma
    one = lambda x: clamp(1.0 - F.exp(-x), 0.0, 1.0)
    first, second = lam(0) + lam(1) + lam(2), lam(3) + lam(4) + lam(5)
    df = df.withColumns(
        {
            "early_share": F.when(total > 0, (lam(0) + lam(1)) / total),
            "late_share": F.when(total > 0, lam(5) / total),
            "p_1h_goal": one(first),
            "p_2h_goal": one(second),
            "p_2h_two": clamp(1.0 - F.exp(-second) * (1.0 + second), 0.0, 1.0),
            "p_goal_after_75": one(lam(5)),
        }
    )
    return df.withColumns(
        {
            "slow_start": F.coalesce(F.col("early_share") < F.col("prior_early") - 0.05, F.lit(False)).cast("int"),
            "late_goals": F.coalesce(F.col("late_share") > F.col("prior_late") + 0.07, F.lit(False)).cast("int"),
        }
    ).drop("_h", "_a", "_lam")

"""Readable projections of picks and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions.cols import col, ladder
from kickframe.functions.text import from_map

# Market names and evidence labels.
MARKET_LABELS = {
    "OU25_OVER": "Over 2.5 goals",
    "OU25_UNDER": "Under 2.5 goals",
    "BTTS_YES": "Both teams to score: yes",
    "BTTS_NO": "Both teams to score: no",
}
HISTORY_STEPS = [(4, "thin comparable history"), (7, "some comparable history"), (10, "solid comparable history")]
EDGE_STEPS = [(0.02, "an almost fair price"), (0.04, "a small edge"), (0.08, "a solid edge")]
TIER_LABELS = {"T1": "Low", "T2": "Medium", "T3": "High", "T4": "High"}


def percent(p: Column | str) -> Column:
    return F.coalesce(F.concat(F.round(col(p) * 100 + 1e-9).cast("int").cast("string"), F.lit("%")), F.lit("-"))


def edge_label(ev: Column, gap: Column) -> Column:
    return ladder(F.coalesce(ev, gap), EDGE_STEPS, "a strong edge", "an almost fair price")


def explain_picks(picks: DataFrame) -> DataFrame:
    """Title, one line of numbers and the strength of the edge for each pick."""
    implied = F.try_divide(F.lit(1.0), F.col("odds"))
    flags = F.array_join(
        F.array_compact(F.array(F.when(F.col("sterile") > 0, "sterile"), F.when(F.col("assassin") > 0, "assassin"))), ", "
    )
    history = ladder("neff_min", HISTORY_STEPS, "strong comparable history", "unknown comparable history")
    numbers = F.concat_ws(
        " | ",
        F.concat(F.lit("Model "), percent("p_model"), F.lit(" vs price "), percent(implied)),
        F.concat(F.lit("Expected goals "), F.format_string("%.1f", F.col("mu_total") + 1e-9)),
        history,
        F.concat(F.lit("Flags: "), F.when(flags == "", "none").otherwise(flags)),
    )
    market = F.coalesce(from_map(F.col("market"), MARKET_LABELS), F.col("market"))
    return picks.withColumns(
        {
            "title": F.concat("home", F.lit(" vs "), "away", F.lit(" | "), market),
            "numbers": numbers,
            "edge": edge_label(F.col("p_model") * F.col("odds") - 1, F.col("p_model") - implied),
        }
    )


def delivery_rows(preds: DataFrame, min_ev_pct: float, min_conf_pct: float, btts_threshold: float = 0.5) -> DataFrame:
    """Side labels with confidence and EV in percent, kept where either market is value."""
    over, yes = F.col("p_over") >= F.col("p_under"), F.col("p_btts") >= btts_threshold
    df = preds.select(
        "fixture_id",
        F.when(over, "OVER").otherwise("UNDER").alias("ou_lbl"),
        F.when(yes, "YES").otherwise("NO").alias("btts_lbl"),
        (100 * F.when(over, F.col("p_over")).otherwise(F.col("p_under"))).alias("ou_conf_pct"),
        (100 * F.when(over, F.col("p_over") * F.col("odds_over") - 1).otherwise(F.col("p_under") * F.col("odds_under") - 1)).alias("ou_ev_pct"),
        (100 * F.when(yes, F.col("p_btts")).otherwise(1 - F.col("p_btts"))).alias("btts_conf_pct"),
        (100 * F.when(yes, F.col("p_btts") * F.col("odds_yes") - 1).otherwise((1 - F.col("p_btts")) * F.col("odds_no") - 1)).alias("btts_ev_pct"),
    )
    value = lambda m: (F.col(f"{m}_ev_pct") > min_ev_pct) & (F.col(f"{m}_conf_pct") >= min_conf_pct)
    return df.filter(value("ou") | value("btts"))

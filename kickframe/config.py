"""Default parameters. Fixed values that results depend on; every operator takes overrides as arguments."""

from __future__ import annotations

# Per-league Elo step and home edge.
ELO_LEAGUE = {
    "Premier League": (21.0, 58.0),
    "Championship": (22.0, 60.0),
    "Bundesliga": (21.0, 50.0),
    "2. Bundesliga": (22.0, 54.0),
    "Serie A": (20.0, 52.0),
    "Serie B": (21.0, 56.0),
    "La Liga": (20.0, 50.0),
    "Ligue 1": (20.0, 52.0),
    "Ligue 2": (21.0, 57.0),
    "Eredivisie": (21.0, 48.0),
    "Primeira Liga": (20.0, 52.0),
    "Liga I": (21.0, 58.0),
    "Süper Lig": (21.0, 56.0),
    "Serie A Brazil": (21.0, 52.0),
    "Liga Profesional Argentina": (21.0, 56.0),
}
ELO_MATCH_TYPE = {"league": 1.0, "cup": 1.12, "playoff": 1.15, "friendly": 0.75, "unknown": 1.0}

# League scalars as default, bounds and per-league overrides.
LEAGUE_SCALARS = {
    "goal_multiplier": {"default": 1.0, "bounds": (0.5, 2.0), "by_league": {"Serie A Brazil": 1.7}},
    "dispersion": {"default": 0.06, "bounds": (0.0, 0.6), "by_league": {}},
    "dependence": {"default": 0.08, "bounds": (0.0, 0.45), "by_league": {}},
    "low_score_rho": {"default": -0.04, "bounds": (-0.3, 0.3), "by_league": {}},
}

# Decision thresholds for both-teams-to-score.
BTTS_THRESHOLD = {
    "Premier League": 0.53,
    "Championship": 0.52,
    "Bundesliga": 0.61,
    "2. Bundesliga": 0.55,
    "Serie A": 0.48,
    "Serie B": 0.50,
    "La Liga": 0.52,
    "Ligue 1": 0.54,
    "Ligue 2": 0.51,
    "Eredivisie": 0.63,
    "Primeira Liga": 0.48,
    "Liga I": 0.40,
}

# Weights and limits of the expected-count blend.
MEAN_WEIGHTS = {"anchor": 0.40, "rating": 0.10, "xg": 0.25, "pressure": 0.25}
MEAN_LIMITS = {
    "anchor_home": 1.35,
    "anchor_away": 1.15,
    "goals": (0.20, 3.50),
    "share": (0.25, 0.75),
    "total": (0.85, 1.15),
    "strength": 0.70,
}

# Selection gates.
EVIDENCE_PRIMARY = {"Premier League": (4.0, 2.0, 2.0), "Serie A": (3.0, 1.0, 1.0), "Ligue 1": (4.0, 2.0, 2.0)}
EVIDENCE_DEFAULT = (1.0, 1.0, 1.0)
EVIDENCE_FALLBACK = (1.0, 1.0, 1.0)
RAW_SCORE_LEAGUES = ["Ligue 1"]
BLOCKED_MARKETS = {"Ligue 1": ["BTTS_NO"]}
TIER_BONUS = {("Ligue 1", "fallback"): 0.06}
MARKET_BONUS = {
    ("Premier League", "OU25_OVER"): -0.18,
    ("Serie A", "BTTS_NO"): 0.18,
    ("Ligue 1", "OU25_UNDER"): -0.22,
    ("Ligue 1", "BTTS_YES"): -0.08,
}

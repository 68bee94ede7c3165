"""Match rows to side rows (home view, away view) and back, pair keys and rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# side column -> (source on the home side, source on the away side)
SIDE_COLUMNS = {
    "gf": ("ft_home", "ft_away"),
    "ga": ("ft_away", "ft_home"),
    "shots_for": ("shots_h", "shots_a"),
    "shots_against": ("shots_a", "shots_h"),
    "sot_for": ("sot_h", "sot_a"),
    "sot_against": ("sot_a", "sot_h"),
    "corners_for": ("corners_h", "corners_a"),
    "corners_against": ("corners_a", "corners_h"),
    "pos_for": ("pos_h", "pos_a"),
    "pos_against": ("pos_a", "pos_h"),
}


def side_rows(
    df: DataFrame,
    columns: dict[str, tuple[str, str]] | None = None,
    keep: tuple[str, ...] = ("fixture_id", "kickoff", "country", "league"),
) -> DataFrame:
    """Two rows per match with columns named from the side's point of view; one pass, no join."""
    columns = columns or SIDE_COLUMNS

    def one(team: str, opp: str, venue: str, at: int) -> Column:
        return F.struct(
            F.col(team).alias("team"),
            F.col(opp).alias("opp"),
            F.lit(venue).alias("venue"),
            *[F.col(src[at]).alias(name) for name, src in columns.items()],
        )

    both = F.array(one("home", "away", "home", 0), one("away", "home", "away", 1))
    return df.select(*keep, F.inline(both))


def to_matches(sides: DataFrame, values: list[str], key: str = "fixture_id") -> DataFrame:
    """One row per match with ``<value>_home`` and ``<value>_away``; map-side combined aggregation."""
    picks = [
        F.max(F.when(F.col("venue") == v, F.col(c))).alias(f"{c}_{v}") for v in ("home", "away") for c in values
    ]
    return sides.groupBy(key).agg(*picks)


def pair_key(a: str = "home", b: str = "away") -> list[Column]:
    """Order-free key of two teams."""
    return [F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi")]

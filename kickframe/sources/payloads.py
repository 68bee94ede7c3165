"""Nested fixture, statistics and odds payloads to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kickframe.functions.text import to_number

FIXTURES = """response ARRAY<STRUCT<fixture STRUCT<id: BIGINT, date: STRING, status: STRUCT<short: STRING>>, league STRUCT<id: BIGINT, name: STRING, country: STRING, season: BIGINT>,
 teams STRUCT<home: STRUCT<id: BIGINT, name: STRING>, away: STRUCT<id: BIGINT, name: STRING>>, goals STRUCT<home: INT, away: INT>>>"""
STATISTICS = "fixture_id BIGINT, home_id BIGINT, away_id BIGINT, response ARRAY<STRUCT<team STRUCT<id: BIGINT>, statistics ARRAY<STRUCT<type: STRING, value: STRING>>>>"
ODDS = """fixture_id BIGINT, response ARRAY<STRUCT<bookmakers ARRAY<STRUCT<bets ARRAY<STRUCT<name: STRING,
 values ARRAY<STRUCT<value: STRING, label: STRING, handicap: STRING, line: STRING, odd: STRING>>>>>>>>"""

# Accepted names per statistic, words that mark other markets, status codes.
STAT_ALIASES = {
    "shots": ["total shots", "shots total"],
    "sot": ["shots on goal", "shots on target"],
    "shots_off": ["shots off goal", "shots off target"],
    "blocked_shots": ["blocked shots"],
    "corners": ["corner kicks", "corners"],
    "possession": ["ball possession", "possession"],
    "attacks": ["attacks", "total attacks"],
    "dangerous_attacks": ["dangerous attacks", "dangerous attack", "danger attacks"],
    "fouls": ["fouls"],
    "yellow_cards": ["yellow cards", "yellow card"],
    "red_cards": ["red cards", "red card"],
}
PART_TIME = "1st|2nd|first half|second half|half-time|halftime|interval"
NOT_GOALS = "corner|card|booking|result|both teams|clean sheet|odd/even|team"
NOT_PLAIN_BTTS = "result|total goals|/|1st|2nd|half"
FINISHED, UPCOMING = ["FT", "AET", "PEN"], ["NS"]


def tidy(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def is_full_time(name: Column) -> Column:
    return ~name.rlike(PART_TIME)


def is_over_under(name: Column) -> Column:
    return name.contains("over/under") & ~name.rlike(NOT_GOALS)


def is_btts(name: Column) -> Column:
    exact = name.isin("both teams to score", "both teams score", "gg/ng")
    return exact | (name.rlike("both teams to score|both teams score") & ~name.rlike(NOT_PLAIN_BTTS))


def flatten_fixtures(payloads: DataFrame) -> DataFrame:
    """One row per fixture with typed kick-off, teams, league and score."""
    f = payloads.select(F.explode("response").alias("r"))
    stamp = F.regexp_replace("r.fixture.date", "Z$", "+00:00")
    return f.select(
        F.col("r.fixture.id").alias("fixture_id"),
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")).cast("timestamp_ntz").alias("kickoff"),
        F.col("r.fixture.status.short").alias("status"),
        F.col("r.league.name").alias("league"),
        F.col("r.league.country").alias("country"),
        F.col("r.league.season").alias("season"),
        F.col("r.teams.home.id").alias("home_id"),
        F.col("r.teams.home.name").alias("home"),
        F.col("r.teams.away.id").alias("away_id"),
        F.col("r.teams.away.name").alias("away"),
        F.col("r.goals.home").alias("ft_home"),
        F.col("r.goals.away").alias("ft_away"),
    )


def split_status(fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished and upcoming fixtures."""
    return fixtures.filter(F.col("status").isin(FINISHED)), fixtures.filter(F.col("status").isin(UPCOMING))


def flatten_statistics(payloads: DataFrame, stats: dict[str, list[str]] | None = None) -> DataFrame:
    """Wide home/away statistics: the entry with the team's id, else the first / second entry."""
    stats = stats or STAT_ALIASES
    entries = payloads.select("fixture_id", "home_id", "away_id", F.size("response").alias("_k"), F.posexplode("response").alias("_at", "_e"))
    items = entries.select(
        "fixture_id", "home_id", "away_id", "_k", "_at", F.col("_e.team.id").alias("_team"), F.explode_outer("_e.statistics").alias("_s")
    )
    name, value = tidy(F.col("_s.type")), F.col("_s.value")
    per_entry = items.groupBy("fixture_id", "home_id", "away_id", "_k", "_at", "_team").agg(
        *[
            F.min_by(value, F.when(name.isin(als), F.array_position(F.array(*[F.lit(a) for a in als]), name))).alias(f"_v_{s}")
            for s, als in stats.items()
        ]
    )
    pick = lambda s, team, at: F.coalesce(
        F.max(F.when(F.col("_team") == F.col(team), F.struct(F.lit(1).alias("k"), F.col(f"_v_{s}").alias("v")))),
        F.max(F.when((F.col("_at") == at) & (F.col("_k") >= 2), F.struct(F.lit(0).alias("k"), F.col(f"_v_{s}").alias("v")))),
    )
    wide = per_entry.groupBy("fixture_id").agg(
        *[pick(s, f"{side}_id", at).alias(f"{s}_{side}") for s in stats for at, side in enumerate(("home", "away"))]
    )
    return wide.select("fixture_id", *[to_number(F.col(f"{s}_{side}.v")).alias(f"{s}_{side}") for s in stats for side in ("home", "away")])


def flatten_odds(payloads: DataFrame) -> DataFrame:
    """First full-time over/under 2.5 and both-score price in feed order of bookmakers and bets."""
    books = payloads.select("fixture_id", F.posexplode("response").alias("_i", "_r"))
    books = books.select("fixture_id", "_i", F.posexplode("_r.bookmakers").alias("_b", "_book"))
    bets = books.select("fixture_id", "_i", "_b", F.posexplode("_book.bets").alias("_j", "_bet"))
    vals = bets.select("fixture_id", "_i", "_b", "_j", tidy(F.col("_bet.name")).alias("_m"), F.posexplode("_bet.values").alias("_k", "_v"))
    part = lambda c: F.coalesce(F.col(f"_v.{c}"), F.lit(""))
    full = tidy(F.concat_ws(" ", part("value"), part("label"), part("handicap"), part("line")))
    short = tidy(F.concat_ws(" ", part("value"), part("label")))
    vals = vals.withColumns({"_odd": to_number(F.col("_v.odd")), "_t": full, "_s": short})
    word = lambda c, w: F.col(c).rlike(rf"(^|[^a-z0-9.]){w}([^a-z0-9.]|$)")
    m = F.col("_m")
    live = (m != "") & is_full_time(m) & F.col("_odd").isNotNull()
    ou = live & is_over_under(m) & F.col("_t").contains("2.5")
    bt = live & is_btts(m)
    over, under = word("_t", "over"), word("_t", "under")
    yes, no = word("_s", "yes") | word("_s", "gg"), word("_s", "no") | word("_s", "ng")
    place = F.struct("_i", "_b", "_j", "_k")
    first = lambda cond: F.min_by("_odd", F.when(cond, place))
    return vals.groupBy("fixture_id").agg(
        first(ou & over & ~under).alias("odds_over"),
        first(ou & under & ~over).alias("odds_under"),
        first(bt & yes).alias("odds_yes"),
        first(bt & no).alias("odds_no"),
    )


def nested_odds(book: DataFrame, key: str = "fixture_id") -> DataFrame:
    """Long prices ``market, tag, outcome, price`` to one nested map per fixture."""
    outcomes = book.groupBy(key, "market", "tag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "price")))).alias("o"))
    tags = outcomes.groupBy(key, "market").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", F.to_json("o").alias("o"))))).alias("t"))
    return tags.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("market", F.to_json("t").alias("t"))))).alias("markets"))


def nested_price(markets: Column, market: str, outcome: str) -> Column:
    """Price of an outcome: tag ``main``, else ``default``, else any tag."""
    tags = F.from_json(F.try_element_at(markets, F.lit(market)), "map<string,string>")
    at = lambda tag: F.try_element_at(F.from_json(F.try_element_at(tags, F.lit(tag)), "map<string,double>"), F.lit(outcome))
    others = F.transform(F.map_values(tags), lambda j: F.try_element_at(F.from_json(j, "map<string,double>"), F.lit(outcome)))
    return F.coalesce(at("main"), at("default"), F.get(F.filter(others, lambda x: x.isNotNull()), 0))

"""Queries on readers, payloads and sinks; feeds are written from the match view and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kickframe.plans.clean import shots
from kickframe.plans.fixtures import CUTOFF, Tables, sql
from kickframe.plans.registry import query
from kickframe.session import scratch_path
from kickframe.sources import payloads as pl
from kickframe.sources import readers as rd


def ID():
    return F.col("fixture_id")


@query(
    "delimited_scan",
    "S01 S02 S03",
    sql("SELECT fixture_id, league || ' é' AS league, CAST(ft_home AS BIGINT) AS ft_home FROM matches"),
)
def _(t: Tables):
    path = scratch_path(t.spark, "feed")
    feed = t.matches.select("fixture_id", F.concat("league", F.lit(" é")).alias("league"), "ft_home")
    feed.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    found = rd.first_existing(t.spark, [path + "-absent", path])
    schema = T.StructType([T.StructField("fixture_id", T.LongType()), T.StructField("league", T.StringType()), T.StructField("ft_home", T.IntegerType())])
    return rd.read_delimited(t.spark, found, schema)


def fixture_payloads(t: Tables):
    """One payload per league, as a feed would page them; fixtures of a league and month share one."""
    m = t.matches
    status = F.when(F.col("kickoff") < F.lit(CUTOFF).cast("timestamp_ntz"), F.when(ID() % 3 == 0, "AET").otherwise("FT")).otherwise("NS")
    one = F.struct(
        F.struct(ID().alias("id"), F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.struct(status.alias("short")).alias("status")).alias("fixture"),
        F.struct(F.lit(1).cast("bigint").alias("id"), F.col("league").alias("name"), F.col("country").alias("country"), F.year("kickoff").cast("bigint").alias("season")).alias("league"),
        F.struct(
            F.struct((ID() * 2).alias("id"), F.col("home").alias("name")).alias("home"), F.struct((ID() * 2 + 1).alias("id"), F.col("away").alias("name")).alias("away")
        ).alias("teams"),
        F.struct(F.col("ft_home").alias("home"), F.col("ft_away").alias("away")).alias("goals"),
    )
    return m.groupBy("league", F.trunc(F.to_date("kickoff"), "month").alias("page")).agg(F.to_json(F.struct(F.collect_list(one).alias("response"))).alias("value"))


@query(
    "fixture_payloads",
    "S04 S08 S09 S14",
    sql(
        f"""SELECT fixture_id, kickoff, CASE WHEN kickoff >= TIMESTAMP '{CUTOFF}' THEN 'NS' WHEN fixture_id % 3 = 0 THEN 'AET' ELSE 'FT' END AS status, league, country, CAST(year(kickoff) AS BIGINT) AS season, home, away, CAST(ft_home AS BIGINT) AS ft_home FROM matches"""
    ),
)
def _(t: Tables):
    path = scratch_path(t.spark, "payloads")
    fixture_payloads(t).select("value").write.text(path)
    schema = T._parse_datatype_string(pl.FIXTURES)
    raw = t.spark.read.schema(schema).json(path)
    done, up = pl.split_status(pl.flatten_fixtures(raw))
    return done.unionByName(up).select("fixture_id", "kickoff", "status", "league", "country", "season", "home", "away", "ft_home")


@query(
    "statistics_payloads",
    "S05",
    sql(
        """SELECT fixture_id, CAST(shots_h AS DOUBLE) AS shots_home, CAST(shots_a AS DOUBLE) AS shots_away, CAST(corners_h AS DOUBLE) AS corners_home, pos_h AS possession_home, pos_a AS possession_away FROM matches"""
    ),
)
def _(t: Tables):
    stat = lambda name, c: F.struct(F.lit(name).alias("type"), F.col(c).cast("string").alias("value"))
    pct = lambda c: F.struct(F.lit("Ball Possession").alias("type"), F.concat(F.col(c).cast("string"), F.lit("%")).alias("value"))
    side = lambda team, s: F.struct(
        F.struct(team.cast("bigint").alias("id")).alias("team"), F.array(stat("Total Shots", f"shots_{s}"), stat("Corner Kicks", f"corners_{s}"), pct(f"pos_{s}")).alias("statistics")
    )
    home, away = side(ID() * 2, "h"), side(ID() * 2 + 1, "a")
    nameless_h, nameless_a = side(F.lit(None), "h"), side(F.lit(None), "a")
    response = F.when(ID() % 3 == 0, F.array(away, home)).when(ID() % 3 == 1, F.array(home, away)).otherwise(F.array(nameless_h, nameless_a))
    text = t.matches.select(F.to_json(F.struct("fixture_id", (ID() * 2).alias("home_id"), (ID() * 2 + 1).alias("away_id"), response.alias("response"))).alias("j"))
    parsed = text.select(F.from_json("j", pl.STATISTICS).alias("p")).select("p.*")
    out = pl.flatten_statistics(parsed, {k: pl.STAT_ALIASES[k] for k in ("shots", "corners", "possession")})
    return out.select("fixture_id", "shots_home", "shots_away", "corners_home", "possession_home", "possession_away")


@query(
    "odds_payloads",
    "S06 S07",
    sql(
        """SELECT fixture_id, ROUND(odds_over, 6) AS odds_over, ROUND(odds_under, 6) AS odds_under, ROUND(CASE WHEN fixture_id % 4 <> 0 THEN 1.5e0 + (fixture_id % 50) / 100e0 END, 6) AS odds_yes, ROUND(CASE WHEN fixture_id % 4 <> 0 THEN 2.5e0 - (fixture_id % 50) / 100e0 END, 6) AS odds_no FROM matches"""
    ),
)
def _(t: Tables):
    v = lambda value, odd: F.struct(F.lit(value).alias("value"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("handicap"), F.lit(None).cast("string").alias("line"), odd.cast("string").alias("odd"))
    bet = lambda name, *vs: F.struct(F.lit(name).alias("name"), F.array(*vs).alias("values"))
    yes, no = F.lit(1.5) + (ID() % 50) / 100.0, F.lit(2.5) - (ID() % 50) / 100.0
    noise = F.struct(F.array(bet("Goals Over/Under First Half", v("Over 2.5", F.lit(9.0))), bet("Corners Over/Under", v("Over 2.5", F.lit(8.0))), bet("Results/Both Teams To Score", v("Home/Yes", F.lit(7.0)))).alias("bets"))
    main = F.struct(
        F.array(
            bet("Goals  Over/Under", v("Over 1.5", F.lit(1.2)), v("Over 2.5", F.col("odds_over")), v("Under 2.5", F.col("odds_under"))),
            bet("Both Teams To Score", v("Yes", F.when(ID() % 4 != 0, yes)), v("No", F.when(ID() % 4 != 0, no))),
        ).alias("bets")
    )
    late = F.struct(F.array(bet("Goals Over/Under", v("Over 2.5", F.when(F.col("odds_over").isNotNull(), F.lit(5.0))))).alias("bets"))
    text = t.matches.select(F.to_json(F.struct("fixture_id", F.array(F.struct(F.array(noise, main, late).alias("bookmakers"))).alias("response"))).alias("j"))
    return pl.flatten_odds(text.select(F.from_json("j", pl.ODDS).alias("p")).select("p.*"))


@query(
    "file_kinds",
    "S10 S11",
    sql("SELECT kind, COUNT(*) AS n FROM (SELECT 'upcoming' AS kind, fixture_id FROM matches WHERE kickoff >= TIMESTAMP '2001-01-01' UNION ALL SELECT 'results', fixture_id FROM matches WHERE kickoff < TIMESTAMP '2001-01-01') GROUP BY kind"),
)
def _(t: Tables):
    base = scratch_path(t.spark, "folder")
    cols = ["fixture_id", "ft_home", "ft_away"]
    late = F.col("kickoff") >= F.lit(CUTOFF).cast("timestamp_ntz")
    for name, part in (("upcoming", t.matches.filter(late)), ("season_a", t.matches.filter(~late)), ("season_b", t.matches.filter(~late))):
        part.select(*cols).write.option("header", True).csv(f"{base}/x/{name}")
    schema = "fixture_id BIGINT, ft_home INT, ft_away INT"
    df = t.spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(base)
    kinds = df.select(*cols, rd.kind_of(F.regexp_extract(F.col("_metadata.file_path"), "/x/([a-z_]+)/", 1), cols).alias("kind"))
    return kinds.distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_merge", "S12 S23", sql("SELECT fixture_id, CAST(2 + fixture_id % 2 AS BIGINT) AS snapshot, league FROM matches"))
def _(t: Tables):
    a = t.matches.select("fixture_id", F.lit(1).alias("snapshot"), F.lit("old").alias("league"))
    b = t.matches.select("fixture_id", F.lit(2).alias("snapshot"), "league")
    c = t.matches.filter(ID() % 2 == 1).select("fixture_id", F.lit(3).alias("snapshot"), "league")
    return rd.newest_snapshot(rd.union_all([a, b, c]), "fixture_id", "snapshot")


@query(
    "event_log",
    "S15 S16",
    "SELECT event_type AS event, COUNT(*) AS n, ROUND(SUM(value), 6) AS total FROM events GROUP BY event_type",
)
def _(t: Tables):
    path = scratch_path(t.spark, "log")
    rd.append_events(t.read("events").select(F.col("event_type").alias("event"), "value"), path)
    t.spark.range(3).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    log = rd.read_events(t.spark, path, T._parse_datatype_string("event STRING, value DOUBLE"))
    return log.filter("event IS NOT NULL").groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("stable_schema_sink", "S17 S13 U01", sql("SELECT fixture_id, league, home, CAST(NULL AS DOUBLE) AS p_over25 FROM matches"))
def _(t: Tables):
    path = scratch_path(t.spark, "stable")
    contract = T._parse_datatype_string("fixture_id BIGINT, home STRING, p_over25 DOUBLE, league STRING")
    rd.write_stable(t.matches, contract, path, sort=["fixture_id"], partition_by=["league"])
    return t.spark.read.parquet(path).select("fixture_id", "league", "home", "p_over25")


@query(
    "quality_report_sink",
    "S18 Q01",
    sql("SELECT COUNT(*) AS rows, ROUND(COUNT(odds_over) / COUNT(*), 6) AS odds_ratio, ROUND(COUNT(pos_h) / COUNT(*), 6) AS stats_ratio, COUNT(odds_over) / COUNT(*) >= 0.6 AND COUNT(pos_h) / COUNT(*) >= 0.6 AS ok FROM matches"),
)
def _(t: Tables):
    path = scratch_path(t.spark, "report")
    n = F.count(F.lit(1))
    agg = t.matches.agg(n.alias("rows"), (F.count("odds_over") / n).alias("o"), (F.count("pos_h") / n).alias("s"))
    report = agg.select("rows", F.struct(F.col("o").alias("odds"), F.col("s").alias("stats")).alias("coverage"))
    rd.write_report(report, path)
    back = t.spark.read.schema("rows BIGINT, coverage STRUCT<odds: DOUBLE, stats: DOUBLE>").json(path)
    # any ratio of the report by its flattened path
    flat = back.select("rows", F.from_json(F.to_json("coverage"), "map<string,double>").alias("m"))
    ratio = lambda k: F.element_at("m", k)
    return flat.select("rows", ratio("odds").alias("odds_ratio"), ratio("stats").alias("stats_ratio"), ((ratio("odds") >= 0.6) & (ratio("stats") >= 0.6)).alias("ok"))


@query(
    "nested_odds_lookup",
    "S19 S20",
    sql("SELECT fixture_id, ROUND(CASE WHEN fixture_id % 2 = 0 THEN odds_over ELSE odds_over + 0.1 END, 6) AS over_price, ROUND(odds_under, 6) AS under_price FROM matches WHERE odds_over IS NOT NULL"),
)
def _(t: Tables):
    rows = F.array_compact(
        F.array(
            F.when(ID() % 2 == 0, F.struct(F.lit("OU 2.5").alias("market"), F.lit("main").alias("tag"), F.lit("Over").alias("outcome"), F.col("odds_over").alias("price"))),
            F.struct(F.lit("OU 2.5").alias("market"), F.lit("default").alias("tag"), F.lit("Over").alias("outcome"), (F.col("odds_over") + 0.1).alias("price")),
            F.struct(F.lit("OU 2.5").alias("market"), F.lit("alt").alias("tag"), F.lit("Under").alias("outcome"), F.col("odds_under").alias("price")),
        )
    )
    book = t.matches.filter("odds_over IS NOT NULL").select("fixture_id", F.inline(rows))
    nested = pl.nested_odds(book)
    return nested.select("fixture_id", pl.nested_price(F.col("markets"), "OU 2.5", "Over").alias("over_price"), pl.nested_price(F.col("markets"), "OU 2.5", "Under").alias("under_price"))


@query(
    "fixtures_from_odds",
    "S21",
    sql(f"SELECT DISTINCT fixture_id, kickoff FROM matches WHERE odds_over IS NOT NULL AND kickoff >= TIMESTAMP '{CUTOFF}' AND kickoff <= TIMESTAMP '{CUTOFF}' + INTERVAL 30 DAY"),
)
def _(t: Tables):
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    book = t.matches.filter("odds_over IS NOT NULL").select("fixture_id", "kickoff", F.explode(F.array(F.lit("over"), F.lit("under"))).alias("side"))
    soon = book.filter((F.col("kickoff") >= cut) & (F.col("kickoff") <= cut + F.expr("INTERVAL 30 DAYS")))
    return soon.select("fixture_id", "kickoff").distinct()


@query("shot_files", "S22", "SELECT l_orderkey * 10 + l_linenumber AS shot_id, CASE WHEN l_returnflag = 'A' THEN 'Goal' ELSE 'Saved' END AS result, ROUND(0.6e0 + (l_partkey % 40) / 100e0, 6) AS x FROM lineitem")
def _(t: Tables):
    path = scratch_path(t.spark, "shots")
    shots(t).select("shot_id", "result", "x", "h_a").write.json(path)
    return t.spark.read.schema("shot_id BIGINT, result STRING, x DOUBLE").json(path)


@query("content_hash", "Q17", sql("SELECT COUNT(*) AS rows, TRUE AS same_twice, FALSE AS same_after_change FROM matches"))
def _(t: Tables):
    a = rd.fingerprint(t.matches, ["fixture_id", "home", "ft_home"])
    b = rd.fingerprint(t.matches.orderBy(F.desc("home")), ["fixture_id", "home", "ft_home"]).select(F.col("digest").alias("d2"))
    changed = t.matches.withColumn("ft_home", F.when(ID() == 7, 99).otherwise(F.col("ft_home")))
    c = rd.fingerprint(changed, ["fixture_id", "home", "ft_home"]).select(F.col("digest").alias("d3"))
    return a.select("rows", (F.col("digest") == b.select("d2").scalar()).alias("same_twice"), (F.col("digest") == c.select("d3").scalar()).alias("same_after_change"))

"""Base views derived from the test tables: matches, side rows and rated matches, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kickframe.operators.sides import side_rows

CUTOFF = "2001-01-01"


class Tables:
    """Lazy access to the parquet tables and the views built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # feed times are UTC wall clock
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def matches(self) -> DataFrame:
        return build_matches(self)

    @cached_property
    def scored(self) -> DataFrame:
        return self.matches.filter("ft_home IS NOT NULL AND ft_away IS NOT NULL")

    @cached_property
    def rated(self) -> DataFrame:
        """Matches with a stand-in rating per side, a closed formula of the id."""
        i = F.col("fixture_id")
        return self.matches.withColumns(
            {
                "elo_home": F.lit(1400.0) + (i * 37 % 200),
                "elo_away": F.lit(1400.0) + (i * 53 % 200),
            }
        )

    @cached_property
    def sides(self) -> DataFrame:
        return side_rows(self.matches)

    @cached_property
    def seasoned(self) -> DataFrame:
        return self.matches.withColumn("season", season_start("kickoff"))

    @cached_property
    def priced(self) -> DataFrame:
        """Matches with model means and probabilities, the stand-in predictions table."""
        return with_means(self.scored)


def season_start(ts: str | Column) -> Column:
    """First year of the season a moment belongs to; seasons start in August."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.year(c) - (F.month(c) < 8).cast("int")


def build_matches(t: Tables) -> DataFrame:
    lines = t.read("lineitem")
    per_order = lines.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "A").cast("int").alias("ft_home"),
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("ft_away"),
        F.floor(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)) / F.lit(4.0))
        .cast("int")
        .alias("shots_h"),
        F.floor(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)) / F.lit(4.0))
        .cast("int")
        .alias("shots_a"),
        F.count(F.lit(1)).cast("int").alias("n_lines"),
    )
    key = F.col("o_orderkey")
    slot = F.col("o_custkey") % 20
    league = F.col("n_name")
    return (
        t.read("orders")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(t.read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.read("nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.read("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(per_order, key == F.col("l_orderkey"), "left")
        .select(
            key.alias("fixture_id"),
            (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(12 + key % 9).cast("int"))).alias("kickoff"),
            F.col("r_name").alias("country"),
            league.alias("league"),
            F.concat(league, F.lit("-T"), slot.cast("string")).alias("home"),
            F.concat(league, F.lit("-T"), ((slot + 1 + key % 19) % 20).cast("string")).alias("away"),
            "ft_home",
            "ft_away",
            "shots_h",
            "shots_a",
            F.floor(F.col("shots_h") * F.lit(0.35)).cast("int").alias("sot_h"),
            F.floor(F.col("shots_a") * F.lit(0.35)).cast("int").alias("sot_a"),
            (F.col("n_lines") + key % 5).cast("int").alias("corners_h"),
            (F.col("n_lines") + key % 3).cast("int").alias("corners_a"),
            F.when(key % 13 != 0, (30 + key % 41).cast("double")).alias("pos_h"),
            F.when(key % 13 != 0, (70 - key % 41).cast("double")).alias("pos_a"),
            F.when(key % 11 != 0, F.lit(1.5) + (key % 97).cast("double") / 100.0).alias("odds_over"),
            F.when(key % 11 != 0, F.lit(2.6) - (key % 97).cast("double") / 100.0).alias("odds_under"),
        )
    )


def with_means(df: DataFrame) -> DataFrame:
    """Stand-in model output: means, closed-form probabilities, prices, evidence counts and flags."""
    i = F.col("fixture_id")
    mu_h = F.lit(0.6) + (i % 23).cast("double") / 20.0
    mu_a = F.lit(0.5) + (i % 19).cast("double") / 18.0
    df = df.withColumns({"mu_home": mu_h, "mu_away": mu_a})
    total = F.col("mu_home") + F.col("mu_away")
    df = df.withColumn("mu_total", total)
    return df.withColumns(
        {
            "p_under": F.exp(-F.col("mu_total")) * (1 + F.col("mu_total") + F.col("mu_total") * F.col("mu_total") / 2.0),
            "p_btts": (1 - F.exp(-F.col("mu_home"))) * (1 - F.exp(-F.col("mu_away"))),
            "odds_yes": F.when(i % 7 != 0, F.lit(1.6) + (i % 61).cast("double") / 100.0),
            "odds_no": F.when(i % 7 != 0, F.lit(2.4) - (i % 61).cast("double") / 100.0),
            "neff_h": F.when(i % 29 != 0, (i % 12).cast("double")),
            "neff_a": (i % 14).cast("double"),
            "press_n_h": (i % 9).cast("double"),
            "press_n_a": (i % 11).cast("double"),
            "xg_n_h": (i % 8).cast("double"),
            "xg_n_a": (i % 10).cast("double"),
            "sterile": (i % 6 == 0).cast("int"),
            "assassin": (i % 10 == 3).cast("int"),
            "slow_start": (i % 5 == 2).cast("int"),
            "late_goal": (i % 4 == 1).cast("int"),
        }
    ).withColumn("p_over", 1 - F.col("p_under"))


# SQL text of the same views, for the oracle.
LI_CTE = """li AS (
  SELECT l_orderkey,
         CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS INT) AS ft_home,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS ft_away,
         CAST(FLOOR(SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) / 4e0) AS INT) AS shots_h,
         CAST(FLOOR(SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) / 4e0) AS INT) AS shots_a,
         CAST(COUNT(*) AS INT) AS n_lines
  FROM lineitem GROUP BY l_orderkey)"""

MATCHES_CTE = (
    LI_CTE
    + """,
matches AS MATERIALIZED (
  SELECT o.o_orderkey AS fixture_id,
       CAST(o.o_orderdate AS TIMESTAMP) + (12 + o.o_orderkey % 9) * INTERVAL '1' HOUR AS kickoff,
       r.r_name AS country, n.n_name AS league,
       CONCAT(n.n_name, '-T', CAST(o.o_custkey % 20 AS VARCHAR)) AS home,
       CONCAT(n.n_name, '-T', CAST((o.o_custkey % 20 + 1 + o.o_orderkey % 19) % 20 AS VARCHAR)) AS away,
       li.ft_home, li.ft_away, li.shots_h, li.shots_a,
       CAST(FLOOR(li.shots_h * 0.35e0) AS INT) AS sot_h,
       CAST(FLOOR(li.shots_a * 0.35e0) AS INT) AS sot_a,
       CAST(li.n_lines + o.o_orderkey % 5 AS INT) AS corners_h,
       CAST(li.n_lines + o.o_orderkey % 3 AS INT) AS corners_a,
       CAST(CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE 30 + o.o_orderkey % 41 END AS DOUBLE) AS pos_h,
       CAST(CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE 70 - o.o_orderkey % 41 END AS DOUBLE) AS pos_a,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE 1.5e0 + CAST(o.o_orderkey % 97 AS DOUBLE) / 100e0 END AS odds_over,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE 2.6e0 - CAST(o.o_orderkey % 97 AS DOUBLE) / 100e0 END AS odds_under
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN li ON li.l_orderkey = o.o_orderkey)"""
)

SCORED_CTE = "scored AS (SELECT * FROM matches WHERE ft_home IS NOT NULL AND ft_away IS NOT NULL)"

RATED_CTE = (
    "rated AS (SELECT *, 1400e0 + fixture_id * 37 % 200 AS elo_home, 1400e0 + fixture_id * 53 % 200 AS elo_away FROM matches)"
)

SEASONED_CTE = (
    "seasoned AS (SELECT *, CAST(year(kickoff) - CASE WHEN month(kickoff) < 8 THEN 1 ELSE 0 END AS BIGINT) AS season FROM matches)"
)

SIDES_CTE = """sides AS (
  SELECT fixture_id, kickoff, country, league, home AS team, away AS opp, 'home' AS venue,
         ft_home AS gf, ft_away AS ga, shots_h AS shots_for, shots_a AS shots_against, sot_h AS sot_for,
         sot_a AS sot_against, corners_h AS corners_for, corners_a AS corners_against, pos_h AS pos_for, pos_a AS pos_against
  FROM matches UNION ALL
  SELECT fixture_id, kickoff, country, league, away, home, 'away', ft_away, ft_home, shots_a, shots_h, sot_a, sot_h,
         corners_a, corners_h, pos_a, pos_h
  FROM matches)"""

PRICED_CTE = """pr0 AS (
  SELECT *, 0.6e0 + CAST(fixture_id % 23 AS DOUBLE) / 20e0 AS mu_home, 0.5e0 + CAST(fixture_id % 19 AS DOUBLE) / 18e0 AS mu_away
  FROM matches WHERE ft_home IS NOT NULL AND ft_away IS NOT NULL),
pr1 AS (SELECT *, mu_home + mu_away AS mu_total FROM pr0),
priced AS (
  SELECT *, exp(-mu_total) * (1 + mu_total + mu_total * mu_total / 2e0) AS p_under,
         1 - exp(-mu_total) * (1 + mu_total + mu_total * mu_total / 2e0) AS p_over,
         (1 - exp(-mu_home)) * (1 - exp(-mu_away)) AS p_btts,
         CASE WHEN fixture_id % 7 <> 0 THEN 1.6e0 + CAST(fixture_id % 61 AS DOUBLE) / 100e0 END AS odds_yes,
         CASE WHEN fixture_id % 7 <> 0 THEN 2.4e0 - CAST(fixture_id % 61 AS DOUBLE) / 100e0 END AS odds_no,
         CASE WHEN fixture_id % 29 <> 0 THEN CAST(fixture_id % 12 AS DOUBLE) END AS neff_h,
         CAST(fixture_id % 14 AS DOUBLE) AS neff_a, CAST(fixture_id % 9 AS DOUBLE) AS press_n_h,
         CAST(fixture_id % 11 AS DOUBLE) AS press_n_a, CAST(fixture_id % 8 AS DOUBLE) AS xg_n_h,
         CAST(fixture_id % 10 AS DOUBLE) AS xg_n_a, CAST(fixture_id % 6 = 0 AS INT) AS sterile,
         CAST(fixture_id % 10 = 3 AS INT) AS assassin, CAST(fixture_id % 5 = 2 AS INT) AS slow_start,
         CAST(fixture_id % 4 = 1 AS INT) AS late_goal
  FROM pr1)"""

_VIEWS = {"scored": SCORED_CTE, "rated": RATED_CTE, "seasoned": SEASONED_CTE, "sides": SIDES_CTE, "priced": PRICED_CTE}


def sql(select: str, views: str = "", ctes: str = "") -> str:
    """Oracle text: the match view, the named extra views, own CTEs, then the final select."""
    parts = [MATCHES_CTE, *[_VIEWS[v] for v in views.split()]]
    if ctes:
        parts.append(ctes)
    head = "WITH RECURSIVE " if "RECURSIVE_" in ctes else "WITH "
    return head + ",\n".join(parts).replace("RECURSIVE_", "") + "\n" + select

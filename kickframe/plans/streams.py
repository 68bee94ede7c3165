"""Queries that drain a stream built on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kickframe.operators import ratings as rt
from kickframe.plans.fixtures import Tables, sql
from kickframe.plans.forms import PRE
from kickframe.plans.ratings import ELO_CTE, rules, typed
from kickframe.plans.registry import query
from kickframe.session import scratch_path
from kickframe.streaming import operators as so


#: How late a row may arrive in these queries: tables come in slices of time, so one day is more than enough.
DELAY = "1 day"
#: Days of rows that wait together; a key waits with at most the rows of a slice and the delay.
BUCKET = 365
#: Events in a file of an arrival, about.
ARRIVAL_ROWS = 1_000_000


def event_stream(t: Tables):
    # the table itself, a file or a folder of files: a stream takes a single file only as a pattern
    return so.file_stream(t.spark, f"{t.sf_dir}/events.parque[t]", t.read("events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_dedupe",
    "ST1",
    "SELECT event_id, event_type FROM events",
)
def _(t: Tables):
    path = scratch_path(t.spark, "arrivals")
    ev = t.read("events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    ev.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy").write.parquet(path)
    stream = so.file_stream(t.spark, path, ev.schema)
    return so.drain(so.dedupe_stream(stream, ["event_id"], "ts", "60 days"), "dedupe").select("event_id", "event_type")


@query(
    "stream_latest_versions",
    "ST1",
    "SELECT event_id, CAST(ts + INTERVAL 1 HOUR * (event_id % 3) AS TIMESTAMP) AS version_ts, event_type, ROUND(value + event_id % 3, 6) AS value FROM events",
)
def _(t: Tables):
    """Up to three versions of every event, the last one twice, dealt to three arrivals regardless of their order: the latest one stays."""
    ev = t.read("events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    v = F.explode(F.concat(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")), F.array((F.col("event_id") % 3).cast("int"))))
    feed = ev.withColumn("v", v).withColumns({"ts": F.col("ts") + F.make_dt_interval(hours=F.col("v")), "value": F.col("value") + F.col("v")})
    # arrivals mix all times, so the delay covers the whole table
    delay = "4000 days"
    feed = so.with_end(feed, "ts", delay, {"event_type": F.lit("end")})
    path = scratch_path(t.spark, "updates")
    files = max(1, math.ceil(ev.count() / ARRIVAL_ROWS))  # of one arrival; any file may come at any time but the closing row's
    feed.where("event_id IS NOT NULL").repartition(3 * files, "event_id", "v").write.parquet(path)
    feed.where("event_id IS NULL").coalesce(1).write.mode("append").parquet(path)
    stream = so.latest_versions(so.file_stream(t.spark, path, feed.schema, per_trigger=files), ["event_id"], "ts", "v", ["event_type", "value"], "1 day", delay)
    out = so.newest(so.drain(stream, "versions"), ["event_id"])
    return out.where("event_id IS NOT NULL").select("event_id", F.col("version_ts").cast("timestamp_ntz").alias("version_ts"), "event_type", "value")


@query(
    "stream_price_expiry",
    "ST5",
    """SELECT user_id, event_type, CAST(ts AS TIMESTAMP) AS ts, ROUND(value, 6) AS price, ts < (SELECT MAX(ts) FROM events) - INTERVAL 6 HOUR AS stale FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""",
)
def _(t: Tables):
    """Prices with expiry: the latest one of every key, stale if the stream has said so."""
    ev = t.read("events").select("user_id", "event_type", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    # the closing row brings the watermark to the last event
    last = ev.agg((F.max("ts") + F.expr(f"INTERVAL {DELAY}")).alias("ts")).where("ts IS NOT NULL").withColumns({"event_type": F.lit("end"), "user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long"), "value": F.lit(0.0)})
    ev = ev.unionByName(last, allowMissingColumns=True)
    out = so.drain_in_order(ev, "ts", lambda s: so.price_changes(s, ["user_id", "event_type"], "ts", "value", "event_id", 6, DELAY), "expiry", by=["user_id", "event_type"])
    won = out.where("event_type <> 'end'").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "tie", "stale", "price")).alias("w"))
    return won.select("user_id", "event_type", F.col("w.ts").cast("timestamp_ntz").alias("ts"), F.col("w.price").alias("price"), F.col("w.stale").alias("stale"))


@query(
    "stream_windows",
    "ST2",
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, COUNT(*) AS rows, COUNT(*) FILTER (value > 50) AS present FROM events GROUP BY ALL",
)
def _(t: Tables):
    return so.drain(so.window_coverage(event_stream(t), "ts", ["event_type"], F.col("value") > 50), "windows", "complete")


@query(
    "stream_ratings",
    "ST3",
    sql("SELECT fixture_id, ROUND(eh, 6) AS elo_home, ROUND(ea, 6) AS elo_away, ROUND(d, 6) AS delta FROM st WHERE rn > 0", "", ELO_CTE),
)
def _(t: Tables):
    cols = ["fixture_id", F.col("kickoff").cast("timestamp").alias("kickoff"), "league", "home", "away", "k_base", "home_edge", "type_mult", "margin_mult", "actual"]
    df = rt._static(typed(t), rules()).select(*cols)
    df = so.with_end(df, "kickoff", DELAY, {"league": F.lit("end"), "home": F.lit("end"), "away": F.lit("end")})
    out = so.drain_in_order(df, "kickoff", lambda stream: so.ratings_stream(stream, "league", rules(), DELAY, BUCKET), "ratings", by=["league"])
    return out.select("fixture_id", "elo_home", "elo_away", F.when(~F.isnan("delta"), F.col("delta")).alias("delta"))


@query(
    "stream_form",
    "ST4",
    sql(f"SELECT fixture_id, team, venue, ROUND(AVG(gf) OVER {PRE}, 6) AS form, COUNT(gf) OVER {PRE} AS n FROM sides", "sides"),
)
def _(t: Tables):
    df = t.sides.select("fixture_id", "team", "venue", F.col("kickoff").cast("timestamp").alias("kickoff"), "opp", F.col("gf").cast("double").alias("gf"))
    df = so.with_end(df, "kickoff", DELAY, {"team": F.lit("end"), "venue": F.lit("end")})
    out = so.drain_in_order(df, "kickoff", lambda stream: so.form_stream(stream, "gf", delay=DELAY, bucket_days=BUCKET), "form", by=["team", "venue"])
    return out.select("fixture_id", "team", "venue", F.when(~F.isnan("form"), F.col("form")).alias("form"), "n")


@query(
    "stream_price_freshness",
    "ST5",
    """SELECT user_id, event_type, ts, ROUND(value, 6) AS price, ts < (SELECT MAX(ts) FROM events) - INTERVAL 6 HOUR AS stale FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""",
)
def _(t: Tables):
    latest = so.drain(so.latest_prices(event_stream(t), ["user_id", "event_type"], "ts", "value", "event_id"), "prices", "complete")
    return so.mark_stale(latest).select("user_id", "event_type", "ts", "price", "stale")

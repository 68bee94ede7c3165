"""Stateful streams give the batch result for any batching of their input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kickframe.operators import ratings as rt
from kickframe.streaming import operators as so

DELAY = "10000 days"


@pytest.fixture(scope="module")
def matches(spark):
    rnd = random.Random(4)
    rows = [(i, f"L{i % 2}", f"T{rnd.randrange(8)}", f"U{rnd.randrange(8)}", 1_000_000_000 + rnd.randrange(200) * 86400, rnd.choice([0, 1, 2, None]), rnd.randrange(3)) for i in range(240)]
    df = spark.createDataFrame(rows, "fixture_id long, league string, home string, away string, t long, ft_home int, ft_away int")
    return df.withColumn("kickoff", F.timestamp_seconds("t")).cache()


def in_three_files(df, path, marks):
    """Unsorted thirds, one file each, and the closing row in a file of its own."""
    whole = so.with_end(df, "kickoff", DELAY, marks)
    for k in range(3):
        whole.where((F.pmod(F.xxhash64("fixture_id"), F.lit(3)) == k) & F.col("fixture_id").isNotNull()).coalesce(1).write.mode("append").parquet(path)
    whole.where("fixture_id IS NULL").coalesce(1).write.mode("append").parquet(path)
    return whole.schema


def test_ratings(spark, matches, tmp_path):
    rules = rt.EloRules()
    cols = ["fixture_id", "kickoff", "league", "home", "away", "k_base", "home_edge", "type_mult", "margin_mult", "actual"]
    schema = in_three_files(rt._static(matches, rules).select(*cols), f"{tmp_path}/m", {"league": F.lit("end"), "home": F.lit("end"), "away": F.lit("end")})
    out = so.drain(so.ratings_stream(so.file_stream(spark, f"{tmp_path}/m", schema, per_trigger=1), "league", rules, DELAY), "ratings").collect()
    want = {r["fixture_id"]: r for r in rt.elo_series(matches, "league", rules).collect()}
    assert len(out) == len(want)
    for r in out:
        assert abs(r["elo_home"] - want[r["fixture_id"]]["elo_home"]) < 1e-9 and abs(r["elo_away"] - want[r["fixture_id"]]["elo_away"]) < 1e-9


def test_form(spark, matches, tmp_path):
    sides = matches.select("fixture_id", F.col("home").alias("team"), F.lit("home").alias("venue"), "kickoff", F.col("away").alias("opp"), F.col("ft_home").cast("double").alias("gf"))
    schema = in_three_files(sides, f"{tmp_path}/s", {"team": F.lit("end"), "venue": F.lit("end")})
    out = so.drain(so.form_stream(so.file_stream(spark, f"{tmp_path}/s", schema, per_trigger=1), "gf", 5, DELAY), "form").collect()
    rows: dict = {}
    for r in sorted(sides.collect(), key=lambda r: (r["kickoff"], r["opp"], r["fixture_id"])):
        rows.setdefault(r["team"], []).append(r)
    got = {r["fixture_id"]: r for r in out}
    assert len(out) == 240
    for own in rows.values():
        for i, r in enumerate(own):
            past = [x["gf"] for x in own[max(0, i - 5) : i] if x["gf"] is not None]
            g = got[r["fixture_id"]]
            assert g["n"] == len(past) and (not past or abs(g["form"] - sum(past) / len(past)) < 1e-9)


def test_slices_of_time_with_a_short_delay(spark, matches):
    rules = rt.EloRules()
    cols = ["fixture_id", "kickoff", "league", "home", "away", "k_base", "home_edge", "type_mult", "margin_mult", "actual"]
    whole = so.with_end(rt._static(matches, rules).select(*cols), "kickoff", "1 day", {"league": F.lit("end"), "home": F.lit("end"), "away": F.lit("end")})
    out = so.drain_in_order(whole, "kickoff", lambda s: so.ratings_stream(s, "league", rules, "1 day"), "ratings", slice_rows=60).collect()
    want = {r["fixture_id"]: r for r in rt.elo_series(matches, "league", rules).collect()}
    assert len(out) == len(want) == 240
    assert all(abs(r["elo_home"] - want[r["fixture_id"]]["elo_home"]) < 1e-9 for r in out)


class Memory:
    """The state of one key, in memory."""

    def __init__(self):
        self.maps, self.timers, self.value = {}, set(), None

    def getMapState(self, name, *_):
        return MapOf(self.maps.setdefault(name, {}))

    def getListState(self, name, *_):
        return ListOf()

    def getValueState(self, *_):
        return ValueOf()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class MapOf:
    def __init__(self, d):
        self.d = d
        self.containsKey, self.getValue, self.updateValue, self.removeKey = d.__contains__, d.get, d.__setitem__, d.pop

    def iterator(self):
        return iter(list(self.d.items()))


class ListOf:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def appendList(self, rows):
        self.rows = [*self.rows, *rows]

    def clear(self):
        self.rows = []


class ValueOf:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


def test_a_long_key_leaves_in_small_frames_bucket_by_bucket(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(so, "FRAME", 50, raising=False)
    monkeypatch.setattr(so, "PART", 7, raising=False)
    rnd = random.Random(5)
    days = [rnd.randrange(-20, 100) + rnd.random() for _ in range(1000)]
    pdf = pd.DataFrame({"kickoff": pd.to_datetime([d * 86400 for d in days], unit="s"), "opp": "x", "fixture_id": range(1000), "value": [float(i) for i in range(1000)]})
    p, memory = so._LastN(3), Memory()
    p.init(memory)
    for k in range(0, 1000, 300):
        assert not list(p.handleInputRows(("t", "home"), iter([pdf[k : k + 300]]), None))
    frames, held = [], []
    for mark in (50.5, 1000.0):  # the first one cuts a bucket
        assert len(memory.timers) == 1
        memory.timers.clear()
        now = type("Now", (), {"getCurrentWatermarkInMs": lambda self, m=mark: int(m * 86_400_000)})()
        for frame in p.handleExpiredTimer(("t", "home"), now, None):
            frames.append(frame)
            held.append(len(memory.maps["buckets"]))
    assert max(map(len, frames)) <= 50 and held[0] > 90
    order = pdf.sort_values("kickoff")["fixture_id"].tolist()
    assert [i for f in frames for i in f["fixture_id"]] == order
    means = [m for f in frames for m in f["form"]]
    assert all(abs(means[i] - sum(order[max(0, i - 3) : i]) / min(i, 3)) < 1e-9 for i in range(1, 1000))


def test_the_latest_version_wins_over_three_triggers(spark, tmp_path):
    """Changed, late and repeated updates, dealt to triggers in no order, give the batch result."""
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        at = 1_000_000_000 + rnd.randrange(50) * 86400
        updates = [(i, at + k * 3600, k, f"v{k}", rnd.randrange(100)) for k in range(rnd.randint(1, 4))]
        rows += updates + rnd.choices(updates, k=2)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, t long, seq long, status string, score long").withColumn("ts", F.timestamp_seconds("t"))
    whole = so.with_end(df, "ts", DELAY, {"status": F.lit("end")})
    for k in range(3):
        whole.where((F.pmod(F.xxhash64("id", "seq"), F.lit(3)) == k) & F.col("id").isNotNull()).coalesce(1).write.mode("append").parquet(f"{tmp_path}/v")
    whole.where("id IS NULL").coalesce(1).write.mode("append").parquet(f"{tmp_path}/v")
    stream = so.latest_versions(so.file_stream(spark, f"{tmp_path}/v", whole.schema, per_trigger=1), ["id"], "ts", "seq", ["status", "score"], "1 day", DELAY)
    got = {r["id"]: (r["version_tie"], r["status"], r["score"]) for r in so.newest(so.drain(stream, "versions"), ["id"]).where("id IS NOT NULL").collect()}
    want = {}
    for i, _, seq, status, score in rows:
        want[i] = max(want.get(i, (-1, "", 0)), (seq, status, score))
    assert got == want


def test_prices_turn_stale_once_and_are_forgotten():
    import pandas as pd

    p, memory = so._Freshness(6 * 3_600_000, ["user", "ts", "tie", "price", "stale"]), Memory()
    p.init(memory)
    at = lambda h: pd.Timestamp(h * 3600, unit="s")
    arrive = lambda *rows: list(p.handleInputRows(("u",), iter([pd.DataFrame(rows, columns=["ts", "tie", "price"])]), None))
    first = arrive((at(1), 1, 10.0), (at(3), 2, 11.0), (at(2), 3, 12.0))
    assert [f.values.tolist() for f in first] == [[["u", at(3), 2, 11.0, False]]]
    assert arrive((at(2), 9, 1.0)) == []  # an older price changes nothing
    assert [f["price"][0] for f in arrive((at(4), 1, 13.0))] == [13.0]
    assert memory.timers == {10 * 3_600_000 + 1}
    gone = list(p.handleExpiredTimer(("u",), None, None))
    assert [f.values.tolist() for f in gone] == [[["u", at(4), 1, 13.0, True]]]
    assert not p.last.exists() and list(p.handleExpiredTimer(("u",), None, None)) == []


def test_null_keys_of_prices_lose_no_rows(spark, tmp_path):
    users = [1, 2, 3, None, 4, 5, 6, 7, 8, None, 9, 10]
    rows = [(u, None if u == 6 else "a", i, float(i), 1_700_000_000 + i * 60) for i, u in enumerate(users)]
    df = spark.createDataFrame(rows, "user_id long, kind string, event_id long, value double, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/p")
    out = so.drain(so.price_changes(so.file_stream(spark, f"{tmp_path}/p", df.schema), ["user_id", "kind"], "ts", "value", "event_id"), "nulls")
    got = sorted(((r["user_id"], r["kind"], r["tie"]) for r in out.collect() if not r["stale"]), key=str)
    want = {(u, k): i for u, k, i, _, _ in rows}
    assert got == sorted(((u, k, i) for (u, k), i in want.items()), key=str)


def test_a_slot_of_many_prices_leaves_in_one_frame_with_one_timer():
    import pandas as pd

    p, memory = so._Freshness(6 * 3_600_000, ["key", "ts", "tie", "price", "stale"]), Memory()
    p.init(memory)
    hours = [i % 10 for i in range(1000)]
    pdf = pd.DataFrame({"key": [f"k{i % 500}" for i in range(1000)], "ts": pd.to_datetime([h * 3600 for h in hours], unit="s"), "tie": range(1000), "price": [float(i) for i in range(1000)]})
    (fresh,) = p.handleInputRows((3,), iter([pdf[:600], pdf[600:]]), None)
    assert sorted(zip(fresh["key"], fresh["tie"], strict=True)) == sorted((f"k{i}", i + 500) for i in range(500)) and not fresh["stale"].any()
    assert memory.timers == {6 * 3_600_000 + 1}
    memory.timers.clear()
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 10 * 3_600_000 + 1})()
    (gone,) = p.handleExpiredTimer((3,), now, None)  # prices of hours 0 to 4 turn stale together
    assert sorted(gone["tie"]) == [i for i in range(500, 1000) if hours[i] <= 4] and gone["stale"].all()
    assert memory.timers == {11 * 3_600_000 + 1} and len(p._held()) == 250


def test_slices_go_by_the_largest_key_and_the_cores(spark, matches):
    assert so.slice_count(matches, 60) == 4
    assert so.slice_count(matches, 60, ["league"]) == 2 and so.slice_count(matches, 60, ["home"]) == 1 and so.slice_count(matches.limit(0), 60, ["home"]) == 0
    rules = rt.EloRules()
    cols = ["fixture_id", "kickoff", "league", "home", "away", "k_base", "home_edge", "type_mult", "margin_mult", "actual"]
    whole = so.with_end(rt._static(matches, rules).select(*cols), "kickoff", "1 day", {"league": F.lit("end"), "home": F.lit("end"), "away": F.lit("end")})
    out = so.drain_in_order(whole, "kickoff", lambda s: so.ratings_stream(s, "league", rules, "1 day"), "ratings", slice_rows=60, by=["league"]).collect()
    want = {r["fixture_id"]: r["elo_home"] for r in rt.elo_series(matches, "league", rules).collect()}
    assert len(out) == 240 and all(abs(r["elo_home"] - want[r["fixture_id"]]) < 1e-9 for r in out)

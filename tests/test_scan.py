"""Affine scans and weighed histories over many slices equal plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kickframe.operators import forms as fm
from kickframe.operators.scan import affine_scan, compose


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(8)
    data = []
    for i in range(700):
        key = "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None])
        data.append((i, key, 1_000_000_000 + rnd.randrange(400) * 43_200, None if rnd.random() < 0.3 else rnd.random(), float(rnd.randrange(9)), rnd.gauss(1500, 60)))
    return spark.createDataFrame(data, "id long, key string, t long, keep double, add double, elo double").cache()


def test_compose_equals_the_loop():
    rng = np.random.default_rng(2)
    a, b = rng.random((77, 3)), rng.random((77, 3))
    got_a, got_b = compose(a, b)
    e = np.array([2.0, -1.0, 0.5])
    for k in range(77):
        e = a[k] * e + b[k]
        assert np.allclose(got_a[k] * np.array([2.0, -1.0, 0.5]) + got_b[k], e)


@pytest.mark.parametrize("size", [25, 10_000])
def test_scan_over_slices_equals_the_loop(rows, size):
    states = {"x": (F.col("keep"), F.col("add"), 3.0), "y": (F.lit(0.9), F.when(F.col("add") > 4, F.col("add")), F.when(F.col("key") == "hot", 7.0).otherwise(1.0))}
    got = affine_scan(rows, ["key"], ["t", "id"], F.col("t"), states, rows=size).collect()
    assert len(got) == 700
    for key in {r["key"] for r in got}:
        x, y = 3.0, 7.0 if key == "hot" else 1.0
        for r in sorted((r for r in got if r["key"] == key), key=lambda r: (r["t"], r["id"])):
            assert abs(r["x"] - x) < 1e-9 and abs(r["y"] - y) < 1e-9
            x = x if r["keep"] is None else r["keep"] * x + r["add"]
            y = 0.9 * y + r["add"] if r["add"] > 4 else y


@pytest.mark.parametrize("size", [60, 10_000])
def test_strength_form_over_slices_equals_the_loop(rows, size):
    c = F.col
    goals = F.when(c("id") % 11 != 0, c("id") % 5)
    sides = rows.select(c("id").alias("fixture_id"), c("key").alias("team"), F.timestamp_seconds("t").cast("timestamp_ntz").alias("kickoff"), c("t"), c("elo").alias("opp_elo"), goals.alias("gf"), (c("id") % 3).alias("ga"), *[(c("id") % k + 1).alias(n) for n, k in (("shots_for", 7), ("shots_against", 6), ("corners_for", 4), ("corners_against", 3))], (c("id") % 4).alias("pts"))
    got = fm.strength_form(sides, max_hist=40, rows=size).collect()
    assert len(got) == 700
    for key in {r["team"] for r in got}:
        mine = sorted((r for r in got if r["team"] == key), key=lambda r: (r["t"], r["fixture_id"]))
        for k, r in enumerate(mine):
            hist = mine[max(0, k - 40) : k]
            used = [p for p in hist if p["t"] < r["t"]]
            if not used:
                assert r["num_matches"] == 0 and r["points_per_game"] is None
                continue
            if len(used) >= 3:
                w = [np.exp(-((r["t"] - p["t"]) // 86400) / 180.0) * np.exp(-0.5 * ((p["opp_elo"] - r["opp_elo"]) / 30.0) ** 2) for p in used]
                ppg, count = np.dot(w, [p["pts"] for p in used]) / sum(w), len(used)
            else:
                last = hist[-3:]
                ppg, count = np.mean([p["pts"] for p in last]), min(len(hist), 3)
            assert r["num_matches"] == count and abs(r["points_per_game"] - ppg) < 1e-9

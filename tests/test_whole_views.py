"""Queries over a whole view leave no track out."""

import numpy as np
import pytest

from posekit.operators import stim
from posekit.plans import registry, views

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["a23_track_stats", "w16_select_tracks", "x3_centroids", "p1_clean_tracks", "u1_union_tables", "w4_clamped_smooth"])
def test_every_track_has_its_rows(spark, name):
    points = views.load(spark, DIR, "points")
    if name == "x3_centroids":
        points = points.where("x IS NOT NULL")
    every = {(r[0], r[1]) for r in points.select("recording", "track").distinct().collect()}
    got = {(r[0], r[1]) for r in registry.QUERIES[name](spark, DIR).select("recording", "track").distinct().collect()}
    assert max(t for _, t in every) >= 90 and got == every


@pytest.mark.parametrize("name, a, b", [("j1_side_by_side", "track_fly", "track_ball"), ("j8_track_pairs", "a", "b")])
def test_every_track_has_a_partner(spark, name, a, b):
    every = {r[0] for r in views.load(spark, DIR, "frames").select("track").distinct().collect()}
    got = registry.QUERIES[name](spark, DIR)
    assert {r[0] for r in got.select(a).union(got.select(b)).distinct().collect()} == every


@pytest.mark.parametrize("window, order", [(11, 1), (7, 2), (5, 3), (41, 4), (221, 1)])
def test_short_series_are_smoothed_by_the_window_that_fits(spark, window, order):
    rng = np.random.default_rng(window)
    series = {n: rng.normal(size=n).tolist() for n in range(1, window + 3) if window < 50 or n % 20 in (0, 1) or n > window - 3}
    series[1000] = [1.0, None, 4.0, 2.0, None, 7.0]
    rows = [(n, k, v) for n, s in series.items() for k, v in enumerate(s)]
    got = {(r["t"], r["k"]): r["x"] for r in stim.smoothed(spark.createDataFrame(rows, "t int, k int, x double"), ["x"], ["t"], "k", window, order).collect()}
    for t, s in series.items():
        n, seen = len(s), [k for k, v in enumerate(s) if v is not None]
        filled = np.interp(range(n), seen, [s[k] for k in seen])
        w = min(window, n) - (min(window, n) + 1) % 2
        for i in range(n):
            want = filled[i]
            if len(seen) >= 3 and w > order:
                c = min(max(i, w // 2), n - 1 - w // 2)
                at = np.arange(c - w // 2, c + w // 2 + 1)
                want = np.polyval(np.polyfit(at, filled[at], order), i)
            assert len(seen) >= 3 and abs(got[t, i] - want) < 1e-8 or got[t, i] == s[i]

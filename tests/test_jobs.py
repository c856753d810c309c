"""Learning operators and jobs against NumPy on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.operators import joins, learn, ordering, signal, stim, tracks
from posekit.plans import jobs


def smooth(y, window, order):
    n, seen = len(y), [k for k, v in enumerate(y) if v is not None]
    if len(seen) < 3:
        return np.array([np.nan if v is None else v for v in y], float)
    filled = np.interp(range(n), seen, [y[k] for k in seen])
    w = min(window, n) - (min(window, n) + 1) % 2
    if w <= order:
        return filled
    out = np.empty(n)
    for i in range(n):
        c = min(max(i, w // 2), n - 1 - w // 2)
        at = np.arange(c - w // 2, c + w // 2 + 1)
        out[i] = np.polyval(np.polyfit(at - c, filled[at], order), i - c)
    return out


@pytest.mark.parametrize("order", [1, 2])
def test_kinematics(spark, order):
    rng = np.random.default_rng(3)
    rows, series = [], {}
    for t, n in ((1, 30), (2, 6), (3, 12)):
        path = np.cumsum(rng.normal(size=(n, 2)), axis=0)
        for node, shift in (("Head", 3.0), ("thorax", 0.0), ("abdomen", -3.0)):
            for f in range(n):
                gone = node == "thorax" and f % 7 == 3
                x, y = (None, None) if gone else (float(path[f, 0] + shift + rng.normal() / 9), float(path[f, 1] + rng.normal() / 9))
                rows.append((0, t, f, node, x, y))
                series.setdefault((t, node), []).append((x, y))
    df = spark.createDataFrame(rows, "recording int, track int, frame int, node string, x double, y double")
    got = {(r["track"], r["frame"]): r for r in jobs.track_kinematics(df, ["Head", "thorax", "abdomen"], 80.0, 11, order, ["Thorax"], 26.0).collect()}
    for t in (1, 2, 3):
        s = {n: [smooth([p[a] for p in series[t, n]], 11, order) for a in (0, 1)] for n in ("Head", "thorax", "abdomen")}
        vx, vy = (np.gradient(s["thorax"][a]) * 80 for a in (0, 1))
        ax, ay = (s["Head"][a] - s["abdomen"][a] for a in (0, 1))
        ux, uy = ax / np.hypot(ax, ay), ay / np.hypot(ax, ay)
        turn = np.degrees(np.gradient(np.unwrap(np.arctan2(uy, ux))) * 80)
        for f in range(len(vx)):
            r, absent = got[t, f], f % 7 == 3
            want = {
                "centroid_x": s["thorax"][0][f] / 26, "speed": np.hypot(vx[f], vy[f]) / 26, "forward_velocity": (vx[f] * ux[f] + vy[f] * uy[f]) / 26,
                "lateral_velocity": (-vx[f] * uy[f] + vy[f] * ux[f]) / 26, "heading_deg": np.degrees(np.arctan2(uy[f], ux[f])), "rotational_velocity": turn[f],
            }
            for k, v in want.items():
                assert (r[k] is None) if absent else abs(r[k] - v) < 1e-6, (t, f, k)


def test_kept_tracks_in_nested_arrays(spark):
    recordings = spark.createDataFrame([(1, [[1.0], [2.0], [3.0]]), (2, [[4.0]])], "recording int, tracks array<array<double>>")
    kept = spark.createDataFrame([(1, 2), (1, 0), (2, 0)], "recording int, index int")
    got = {r["recording"]: r["tracks"] for r in jobs.keep_in_tensor(recordings, kept).collect()}
    assert got == {1: [[1.0], [3.0]], 2: [[4.0]]}


def test_collection_filters_and_scopes(spark):
    """Recordings by genotype and number of tracks; a frame is in each of its scopes; an unknown protocol has no stimulus."""
    rows = [(r, t, f, n, float(f * (t + 1)) + x, float(f)) for r in range(4) for t in range(3 if r == 3 else 2) for f in range(1, 13) for n, x in (("head", 2.0), ("thorax", 0.0), ("abdomen", -2.0))]
    points = spark.createDataFrame(rows, "recording int, track int, frame int, node string, x double, y double")
    paths = ["/d/PG/PG_3_f/a/b/v.h5", "/d/PG_20240101/B6VF/a/b/v.h5", "/d/PG/PG_4_BAD/a/b/v.h5", "/d/PG/PG_5/a/b/v.h5"]
    recordings = spark.createDataFrame(list(enumerate(paths)), "recording int, path string")
    pulses = spark.createDataFrame([("short", 1, 20.0, 60.0), ("long", 1, 20.0, 60.0), ("long", 2, 400.0, 460.0)], "seq string, on_index int, start_s double, end_s double")
    lab = jobs.labelled_kinematics(points, recordings, pulses, ["head", "thorax", "abdomen"], 0.025, 5, 1, ["thorax"], tokens=["bad"], most_tracks=2)
    seen = {(r["recording"], r["grp"], r["sequence"], r["is_control"]) for r in lab.collect()}
    assert seen == {(0, "PG3", "short", False), (1, "B6VF", "long", True)}
    got = jobs.directional_velocity(lab, pulses, 10, tables=["per_fly", "per_stim"])
    assert set(got) == {"per_fly", "per_stim"}
    n = {(r["scope"], r["recording"], r["track"]): r["n_frames"] for r in got["per_fly"].collect()}
    assert n == {("shared", r, t): 9 for r in (0, 1) for t in (0, 1)} | {("long", 1, t): 12 for t in (0, 1)}
    assert {(r["scope"], r["recording"], r["on_index"]) for r in got["per_stim"].collect()} == {("shared", 0, 1), ("shared", 1, 1), ("long", 1, 1), ("long", 1, 2)}


def test_kinematics_checks(spark):
    wide = spark.createDataFrame([(1, 1, 0.0, 0.0)], "track int, frame int, x_head double, y_head double")
    with pytest.raises(ValueError, match="fps"):
        stim.kinematics(wide, ["track"], "frame", 0.0, 5, 1, ["head"])
    with pytest.raises(KeyError, match="wing.*head"):
        stim.kinematics(wide, ["track"], "frame", 80.0, 5, 1, ["wing"])


def test_light_sequence_longer_than_the_data(spark):
    df = spark.createDataFrame([("a", k) for k in range(5)], "t string, k int")
    assert stim.light_states(df, [("on", 5)], ["t"], "k").where("light = 'on'").count() == 5
    with pytest.raises(Exception, match="light sequence has 6 frames"):
        stim.light_states(df, [("on", 6)], ["t"], "k").collect()


def test_orders_of_several_columns(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "g string, h string")
    got = ordering.explicit(df, ["g", "h"], {"g": ["b", "a"], "h": ["x"]}).orderBy("g").collect()
    assert [(r["rank_g"], r["rank_h"]) for r in got] == [(2, 1), (1, None)]
    with pytest.raises(ValueError, match="h"):
        ordering.explicit(df, ["g", "h"], {"g": ["a"]})


def test_two_tracks_by_x(spark):
    df = spark.createDataFrame([(1, 7, 5.0), (1, 8, 2.0)], "frame int, instance int, x double")
    got = tracks.named_by_x(df, ["frame"], ["left", "right"]).orderBy("instance").collect()
    assert [r["name"] for r in got] == ["right", "left"]
    with pytest.raises(ValueError, match="exactly two"):
        tracks.named_by_x(df, ["frame"], ["a", "b", "c"])


def test_plain_names(spark):
    given = ["MBON-β′1", "γ2α'1 (x)", "Σκ ’é"]
    got = spark.createDataFrame([(g,) for g in given], "n string").select(S.plain_name("n").alias("p"), S.left_over("n").alias("l"), S.name_issues("n").alias("i")).collect()
    assert [tuple(r) for r in got] == [("MBON-betap1", "", "non-ASCII: β′"), ("gamma2alphap1-x", "", "space, parentheses, non-ASCII: αγ"), ("kappa-", "Σé", "space, non-ASCII: éΣκ’")]


def test_stems(spark):
    stems = spark.createDataFrame([("recording_1",), ("ab",), ("zz",), ("recording_1",)], "stem string")
    names = spark.createDataFrame([("x_recording_12",), ("recording_1",), ("recording_1",), ("cabin",), (None,), ("",)], "name string")
    assert {r["stem"]: r["n"] for r in joins.matches_by_stem(stems, names).collect()} == {"recording_1": 3, "ab": 1, "zz": 0}


def test_stems_against_brute_force(spark):
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abé_"), n))
    names = [word(int(rng.integers(0, 25))) for _ in range(400)] + [None, "aaaaaaaaaa"]
    stems = [word(int(rng.integers(1, 9))) for _ in range(150)] + ["a", "aaaaaaa", "zzzzzzz", "", None]
    got = {r["stem"]: r["n"] for r in joins.matches_by_stem(spark.createDataFrame([(x,) for x in stems], "stem string"), spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    assert got == {x: sum(n is not None and x in n for n in names) if x else 0 for x in stems}


@pytest.mark.parametrize("b, a", [signal.butterworth(3, 0.2), signal.chebyshev1(3, 0.5, 0.2)])
def test_filters_by_blocks_equal_the_recursion(b, a):
    x = np.random.default_rng(0).normal(size=300)
    state, want = np.array([0.3, -0.2, 0.1]), []
    z = [*state, 0.0]
    for v in x:
        y = b[0] * v + z[0]
        z = [z[k + 1] + b[k + 1] * v - a[k + 1] * y for k in range(3)] + [0.0]
        want.append(y)
    for n in (1, 63, 64, 65, 300):
        assert np.allclose(signal._run(b, a, x[:n], state), want[:n], atol=1e-12)


@pytest.mark.parametrize("b, a", [signal.butterworth(3, 0.2), signal.chebyshev1(3, 0.5, 0.2)])
def test_long_series_spread_over_tasks(spark, b, a):
    """Chunks with states carried on equal the recursion over whole series; a last chunk may be tiny."""
    rng = np.random.default_rng(1)
    series = {"long": rng.normal(size=4000).cumsum(), "rest": rng.normal(size=1003), "one": rng.normal(size=50), "tiny": np.arange(4.0), None: rng.normal(size=777)}
    rows = [(g, k, None if k % 17 == 5 and len(x) > 20 else float(v)) for g, x in series.items() for k, v in enumerate(x)] + [("gone", k, None) for k in range(30)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(5)
    got = {}
    for r in signal.low_pass(df, ["g"], "k", "v", b, a, chunk=100).collect():
        got.setdefault(r["g"], {})[r["k"]] = r["filtered"]
    for g, x in series.items():
        at = [k for k in range(len(x)) if not (k % 17 == 5 and len(x) > 20)]
        want = signal.zero_phase(b, a, np.interp(range(len(x)), at, x[at]))
        assert np.allclose([got[g][k] for k in range(len(x))], want, atol=1e-9), g
    assert set(got["gone"].values()) == {None} and len(got["gone"]) == 30


def blobs(spark, k=3, n=40):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0, 0], [20, 0, 5], [0, 30, -9]], float)[:k]
    x = np.concatenate([c + rng.normal(size=(n, 3)) for c in centres])
    rows = [(i, int(i // n), [float(v) for v in r]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id int, blob int, v array<double>")


def test_clusters_and_silhouette(spark):
    x, df = blobs(spark)
    got = learn.clusters(df, "v", 3)
    assert got.groupBy("cluster").agg(F.countDistinct("blob").alias("b"), F.count("*").alias("n")).where("b = 1 AND n = 40").count() == 3
    best = learn.sweep(df, "id", "v", [2, 3, 5], [0], 2).collect()
    assert best[0]["k"] == 3 and best[0]["silhouette"] > best[1]["silhouette"]


def test_map_and_shares(spark):
    x, df = blobs(spark)
    wide = df.select("id", "blob", *[F.col("v")[k].alias(f"f{k}") for k in range(3)])
    scores, shares = learn.principal_components(wide, ["f0", "f1", "f2"], k=2)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([r["scores"] for r in scores.orderBy("id").collect()])
    assert np.allclose(shares, (s**2 / (s**2).sum())[:2])
    assert np.allclose(np.abs(got - got.mean(axis=0)), np.abs(z @ vt.T[:, :2]), atol=1e-8)
    got = jobs.behaviour_map(wide, ["f0", "f1", "f2"], 3, "blob").collect()
    assert len(got) == 3 and len({r["cluster"] for r in got}) == 3 and all(abs(max(v for v in r.asDict().values() if isinstance(v, float)) - 1.0) < 1e-12 for r in got)

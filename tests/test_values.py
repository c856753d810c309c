"""Closed-form cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.functions import windows as W
from posekit.operators import events, filters, joins, learn, naming, signal, stats, stim, tracks
from posekit.sources import io


def series(spark, values, **more):
    rows = [("a", k + 1, None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "track string, frame int, x double")


def column(df, c, order="frame"):
    return [r[c] for r in df.orderBy(order).collect()]


def w1():
    return Window.partitionBy("track").orderBy("frame")


@pytest.mark.parametrize("given, want", [([1, 2, None, None, 5], [1, 2, 2, 2, 5]), ([None, None, 3, 4], [3, 3, 3, 4]), ([None], [None])])
def test_forward_fill(spark, given, want):
    assert column(series(spark, given).withColumn("f", W.forward_fill(F.col("x"), w1())), "f") == want


def test_interpolate(spark):
    got = W.interpolated(series(spark, [None, 1, None, None, 4, None]), "x", w1(), "f")
    assert column(got, "f") == [1, 1, 2, 3, 4, 4]


def test_scalars(spark):
    row = spark.range(1).select(
        S.distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0)).alias("d"),
        S.logistic(F.lit(5.0), 1.0, 2.0, 5.0).alias("half"),
        S.logistic(F.lit(105.0), 1.0, 20.0, 5.0).alias("one"),
        S.effect_size(F.lit(5.0), F.lit(4.0), F.lit(6.0), F.lit(2.0), F.lit(1.0), F.lit(3.0)).alias("e"),
        S.frames_to_seconds(F.lit(300), 30).alias("s"),
        S.seconds_to_clock(F.lit(3661)).alias("c"),
        S.seconds_to_frames(F.lit(10), 30).alias("f"),
        (S.clock_to_seconds(F.lit("01:00:00")) * 30).alias("b"),
        S.circle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0)).alias("line"),
        S.heading_deg(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("no_axis"),
        S.stars(F.lit(None).cast("double")).alias("none"),
    ).first()
    assert (row["d"], row["half"], round(row["one"], 9), row["s"], row["f"], row["b"]) == (5.0, 0.5, 1.0, 10, 300, 108000)
    assert tuple(row["c"]) == (1, 1, 1)
    assert tuple(row["e"]) == (3.0, 5.0, 1.0)
    assert row["line"]["cx"] is None and row["no_axis"] is None and row["none"] == ""


def test_protocols(spark):
    steps = stim.protocol_steps(spark)
    totals = {r["seq"]: (r["total_s"], r["n_on"]) for r in stim.protocol_totals(steps).collect()}
    assert totals["short"] == (360.5, 5) and totals["long"][1] == 15
    assert stim.shared_prefix(steps, "short", "long").first()["shared_s"] == 360.5


def test_labels_are_half_open(spark):
    t = spark.createDataFrame([(0.4,), (0.5,), (60.4,), (60.5,)], "time double")
    pulses = spark.createDataFrame([(1, 0.5, 60.5)], "on_index int, start_s double, end_s double")
    assert column(joins.labelled_times(t, pulses), "stim_on", "time") == [False, True, True, False]


def test_a_frame_falls_in_two_onset_windows(spark):
    t = spark.createDataFrame([(68.0,)], "time double")
    pulses = spark.createDataFrame([(1, 0.5, 60.5), (2, 75.5, 135.5)], "on_index int, start_s double, end_s double")
    got = joins.onset_windows(t, pulses, 10.0, 70.0)
    assert sorted((r["on_index"], r["rel"]) for r in got.collect()) == [(1, 67.5), (2, -7.5)]


def test_long_interval_tables_join_alike(spark, monkeypatch):
    t = spark.range(200).select((F.col("id") * 1.5).alias("time"))
    iv = spark.range(30).select(F.col("id").cast("int").alias("on_index"), (F.col("id") * 10.0).alias("start_s"), (F.col("id") * 10.0 + 25).alias("end_s"))
    key = lambda df: sorted((r["time"], r["on_index"] or -1) for r in df.collect())
    want = key(joins.in_intervals(t, iv))
    assert key(joins.in_intervals(t, iv, small=False)) == want
    monkeypatch.setattr(joins, "SMALL_INTERVALS", 3)
    with pytest.raises(Exception, match="more than 3 intervals"):
        joins.in_intervals(t, iv).collect()


@pytest.mark.parametrize("window, order, derivative", [(5, 1, 0), (7, 2, 0), (7, 2, 1), (9, 3, 0)])
def test_savgol_against_fits(spark, window, order, derivative):
    y = np.random.default_rng(0).normal(size=30)
    got = column(W.savgol(series(spark, y), "x", ["track"], "frame", window, order, "s", derivative), "s")
    h, want = window // 2, []
    for k in range(30):
        c = min(max(k, h), 29 - h)
        p = np.polynomial.Polynomial.fit(np.arange(c - h, c + h + 1), y[c - h : c + h + 1], order)
        want.append((p.deriv() if derivative else p)(k))
    assert np.allclose(got, want, atol=1e-9)
    if order == 1:
        assert np.allclose(column(W.moving_average(series(spark, y), "x", ["track"], "frame", window, "s"), "s"), want, atol=1e-9)
    assert column(W.savgol(series(spark, y[:3]), "x", ["track"], "frame", window, order, "s"), "s") == [None] * 3


def test_gradient_and_unwrap(spark):
    y = np.cumsum(np.random.default_rng(1).uniform(-2.5, 2.5, 40))
    df = series(spark, (y + math.pi) % (2 * math.pi) - math.pi)
    got = np.array(column(W.unwrapped(df, "x", ["track"], "frame", "u"), "u"))
    assert np.allclose(got - got[0], np.unwrap((y + math.pi) % (2 * math.pi) - math.pi) - got[0])
    assert np.allclose(column(series(spark, y).withColumn("g", W.gradient(F.col("x"), w1())), "g"), np.gradient(y))
    assert column(series(spark, [1.0]).withColumn("g", W.gradient(F.col("x"), w1())), "g") == [None]


def test_bins_like_cut(spark):
    pd = pytest.importorskip("pandas")
    y = np.random.default_rng(2).uniform(0, 10, 200)
    assert column(W.equal_bins(series(spark, y), "x", 7, "b"), "b") == pd.cut(y, 7, labels=False).tolist()
    assert column(W.equal_bins(series(spark, [3, 3]), "x", 7, "b"), "b") == pd.cut([3, 3], 7, labels=False).tolist()


def test_filters_keep_missing(spark):
    df = series(spark, [1, None, 2])
    assert column(filters.exclude_values(df, "x", [1.0]), "x") == [None, 2.0]
    assert filters.equals(df, "nope", 1).count() == 0
    assert filters.time_range(df.withColumnRenamed("frame", "time"), 1000, 2000).count() == 0
    assert column(filters.clean(df.withColumn("g", F.lit("a")), "x", "g"), "x") == [1.0, 2.0]
    with pytest.raises(KeyError, match="abdomen"):
        filters.resolve_node(["head", "abdomen"], "tail")
    with pytest.raises(ValueError, match="no feature"):
        filters.feature_columns(["a"], {"x": "^x"}, ["x"])
    twice = df.select("x", F.col("x").alias("x"), "frame")
    assert filters.first_of_repeated_columns(twice).columns == ["x", "frame"]


def test_event_finder_with_omitted_range(spark):
    y = [0] * 3 + [5] * 6 + [0] * 8 + [5] * 10 + [0]
    found = lambda **k: sorted((r["start"], r["end"]) for r in events.find_events(series(spark, y), ["track"], "frame", "x", (1, 9), 2, 3, **k).collect())
    assert found() == [(3, 8), (17, 26)]
    assert found(omit=(2, 10)) == [(17, 26)]
    assert found(omit=(16, 20)) == [(3, 8), (20, 26)]


def test_runs_and_contacts(spark):
    df = series(spark, [9, 1, 1, 1, 9, None, 1, 9])
    assert [(r["start"], r["end"]) for r in events.runs(df, ["track"], "frame", F.col("x") < 5, 1).collect()] == [(2, 4)]
    assert events.contact_onsets(df, ["track"], "frame", "x", 5).count() == 0  # the first has no gap


def test_overlapping_track_is_not_replaced(spark):
    rows = []
    for track, score, dx in ((1, 0.9, 0.0), (2, 0.8, 5.0), (3, 0.7, 300.0), (4, 0.6, 600.0)):
        rows += [(0, track, f, "n", 10.0 + dx, 10.0, score) for f in range(10)]
    rows += [(0, 5, f, "n", 900.0, 1.0, 0.1) for f in range(2)]
    points = spark.createDataFrame(rows, "recording int, track int, frame int, node string, x double, y double, score double")
    n = spark.createDataFrame([(0, 10)], "recording int, n_frames int")
    got = {r["track"]: (r["kept"], r["reason"]) for r in tracks.select_tracks(points, n).collect()}
    assert got[1][0] and got[3][0]
    assert got[2] == (False, "overlaps higher-score track '1'")
    assert got[4] == (False, "exceeds max_tracks=3")
    assert got[5] == (False, "short + low-score parasite")


def test_bootstrap_edges(spark):
    df = spark.createDataFrame([("c", k, 7.0) for k in range(20)] + [("one", 1, 3.0), ("none", 1, None)], "g string, u int, v double")
    got = {r["g"]: (r["point"], r["lo"], r["hi"]) for r in stats.bootstrap_ci(df, ["g"], "u", "v", 50).collect()}
    assert got == {"c": (7.0, 7.0, 7.0), "one": (3.0, 3.0, 3.0), "none": (None, None, None)}
    with pytest.raises(ValueError, match="statistic"):
        stats.statistic_of("mode")


def test_permutation_tests_find_separation(spark):
    rng = np.random.default_rng(0)
    rows = [(b, f"{g}{k}", g, float(rng.normal(0 if g == "Control" else 1.5, 0.3))) for b in range(5) for g in ("Control", "Treated") for k in range(20)]
    df = spark.createDataFrame(rows + [(9, "x", "Treated", 1.0)], "bin int, u string, g string, v double")
    got = stats.binned_test(df, "bin", "u", "v", "g", "Control", 200).collect()
    assert all(abs(r["diff"]) > 0.5 and r["significant"] for r in got if r["bin"] < 5)
    assert [(r["diff"], r["p"]) for r in got if r["bin"] == 9] == [(0.0, 1.0)]
    with pytest.raises(ValueError, match="missing"):
        stats.binned_test(df.drop("v"), "bin", "u", "v", "g", "Control")


def test_bh_is_monotone(spark):
    p = [0.01, 0.04, None, 0.03, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    assert np.allclose([x for x in column(stats.bh_adjust(df), "p_adj", "k") if x is not None], [0.04, 0.16 / 3, 0.16 / 3, 0.9])


def test_low_pass(spark):
    t = np.arange(100) / 100
    y = np.sin(2 * np.pi * 2 * t) + 0.5 * np.sin(2 * np.pi * 40 * t)
    for b, a in (signal.butterworth(3, 0.2), signal.chebyshev1(3, 0.5, 0.2)):
        got = np.array(column(signal.low_pass(series(spark, y), ["track"], "frame", "x", b, a), "filtered"))
        assert got.var() < y.var() and np.abs(got - np.sin(2 * np.pi * 2 * t))[10:-10].max() < 0.15
        assert np.isclose(b.sum() / a.sum(), 1.0)  # unit gain at rest
    b, a = signal.butterworth(2, 0.5)
    assert np.allclose(b, [0.29289322, 0.58578644, 0.29289322]) and np.allclose(a, [1, 0, 0.17157288], atol=1e-8)
    assert column(signal.low_pass(series(spark, [1, 2]), ["track"], "frame", "x", b, a), "filtered") == [1, 2]


def test_components_against_svd(spark):
    x = np.random.default_rng(3).normal(size=(60, 4)) @ np.diag([3, 2, 1, 0.1])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got, shares = learn.principal_components(df, list("abcd"), k=2)
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    mine = np.array(column(got, "scores", "id"))
    assert np.allclose(np.abs(mine), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:2])
    assert learn.components_for([0.6, 0.35, 0.05], 0.95) == 2


def test_names(spark):
    names = spark.createDataFrame([(1, "Full (SHORT)"), (2, "plain"), (3, "other (x)"), (4, "MiXed")], "id int, name string")
    m = spark.createDataFrame([("SHORT", "s"), ("other", "o"), ("mixed", "m")], "key string, value string")
    assert column(naming.resolve(names, "id", "name", m), "resolved", "id") == ["s", "plain", "o", "m"]
    row = spark.range(1).select(S.plain_name(F.lit("α-tub (x)′ é")).alias("p"), S.renamed(F.lit("a b.mp4"), [("replace", " ", "_"), ("suffix", "_v2")]).alias("r")).first()
    assert row["p"] == "alpha-tub-xp-" and tuple(row["r"]) == ("a_b_v2.mp4", True)


def test_metadata_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([('{"Variable": ["A", "Pretrained"], "Arena1": ["1", "y"], "Arena2": ["2", "n"]}',)], "t string")
    got = {r["arena"]: dict(r["metadata"]) for r in io.metadata_rows(df, "t", [], {"Pretrained": "Pretraining"}).collect()}
    assert got == {"Arena1": {"a": "1", "pretraining": "y"}, "Arena2": {"a": "2", "pretraining": "n"}}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.mp4").write_bytes(b"123")
    (tmp_path / "b.txt").write_text("x")
    files = io.inventory(spark, str(tmp_path), "*.mp4").collect()
    assert [(f["path"].rsplit("/", 1)[1], f["length"]) for f in files] == [("a.mp4", 3)]
    df.write.parquet(str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_table(df, str(tmp_path / "t"))


def test_tensor(spark):
    tracks_ = np.random.default_rng(0).uniform(0, 500, (2, 2, 3, 100)).tolist()
    df = spark.createDataFrame([(1, tracks_, ["head", "thorax", "abdomen"])], "recording int, tracks array<array<array<array<double>>>>, node_names array<string>")
    points = io.explode_tensor(df, 30.0)
    assert points.count() == 600 and points.where("track_id = 'track_1'").select("frame").distinct().count() == 100
    one = points.where("track_id = 'track_2' AND node = 'thorax' AND frame = 100").first()
    assert (one["x"], one["y"], one["time"], one["object"]) == (tracks_[1][0][1][99], tracks_[1][1][1][99], 100 / 30.0, "fly_2")
    assert io.single_object(df, 30.0).count() == 300


def test_results_do_not_depend_on_partitions(spark):
    y = np.random.default_rng(4).normal(size=200)
    df = series(spark, y)
    run = lambda d: column(W.interpolated(W.savgol(d, "x", ["track"], "frame", 9, 2, "s"), "s", w1(), "f"), "f")
    assert run(df.repartition(7)) == run(df.coalesce(1))


def test_a_map_keeps_every_key_of_every_column(spark):
    """A genotype that is no name's largest is a key too."""
    from posekit.plans.queries_joins import j11

    names = spark.createDataFrame([("Ring", "SMALL"), ("Ring", "ECONOMY"), ("bolt", "LARGE")], "name string, genotype string")
    got = {(r["key"], r["value"]) for r in j11(names).collect()}
    assert got == {("Ring", "SMALL"), ("ring", "SMALL"), ("bolt", "LARGE"), ("SMALL", "SMALL"), ("ECONOMY", "ECONOMY"), ("LARGE", "LARGE")}


def test_steps_of_just_pi_and_the_least_beyond(spark):
    pi, up = math.pi, np.nextafter(math.pi, 4)
    for step, turns in ((pi, 0), (-pi, 0), (up, 1), (-up, -1), (np.nextafter(pi, 0), 0), (3 * pi, 1), (7.0, 1), (10.0, 2), (-10.0, -2)):
        rows = W.unwrapped(series(spark, [0.0, step]), "x", ["track"], "frame", "u")
        assert abs(column(rows, "u")[1] - (step - turns * 2 * pi)) < 1e-12, step


def test_angles_are_those_of_the_c_library(spark):
    rng = np.random.default_rng(7)
    places = [(float(y), round(float(x), 2)) for y, x in zip(rng.integers(-50, 50, 3000), rng.normal(0, 50, 3000), strict=True)]
    rows = spark.createDataFrame([*places, (0.0, -1.0), (None, 1.0), (1.0, None)], "y double, x double").withColumn("a", S.angle("y", "x")).collect()
    assert [r["a"] for r in rows[:-2]] == [math.atan2(r["y"], r["x"]) for r in rows[:-2]] and [r["a"] for r in rows[-2:]] == [None, None]


@pytest.mark.parametrize("path, date", [
    ("/data/PG/pg_1234560_x/arena3/fly1/clip.mp4", "Unknown"), ("/data/PG_20240107/pg_123460_x/arena3/fly1/clip.mp4", "20240107"), ("/data/231115_TNT_Fine/arena3/c.mp4", "231115"),
    ("/data/20240107/arena3/20230101.mp4", "20240107"), ("/data/PG_202401071/arena3/c.mp4", "Unknown"), ("/data/other/arena3/20230101.mp4", "Unknown"),
])
def test_a_date_is_a_folder_s_start_or_end(spark, path, date):
    assert spark.createDataFrame([(path,)], "path string").select(S.identifier("path")).first()[0] == f"{date}\narena3\nUnknown"

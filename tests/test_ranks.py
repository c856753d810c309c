"""Ranks, quantiles and silhouettes of whole tables against NumPy."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from posekit.operators import learn, ranks, stats


def adjusted(p):
    """Benjamini-Hochberg with NumPy."""
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1.0)
    return out


def test_a_million_tests_are_adjusted_by_many_tasks(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random(900_000) ** 3, np.full(99_990, 1.0), np.zeros(5), np.full(5, 1e-300)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(p)), "p": p}))
    got = stats.bh_adjust(df).toPandas().sort_values("id")
    assert np.allclose(got["p_adj"].to_numpy(), adjusted(p), rtol=1e-12, atol=0)
    plan = stats.bh_adjust(df)._jdf.queryExecution().executedPlan().toString()
    for part in re.split(r"Exchange SinglePartition", plan)[1:]:
        below = part.split("HashAggregate")[1] if "HashAggregate" in part else ""
        assert "_b#" in below.split("\n")[0], "only bucket totals may meet in one task"
    buckets = df.select(ranks.octaves(F.col("p"))).distinct().count()
    assert buckets < 5000


def test_adjusting_within_groups_and_over_nulls(spark):
    rows = [("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", None), (None, 0.5), (None, 0.2), ("b", 0.9)]
    got = {(r["g"], r["p"]): r["p_adj"] for r in stats.bh_adjust(spark.createDataFrame(rows, "g string, p double"), over=["g"]).collect()}
    want = {("a", 0.01): 0.03, ("a", 0.04): 0.04, ("a", 0.03): 0.04, ("a", None): None, (None, 0.5): 0.5, (None, 0.2): 0.4, ("b", 0.9): 0.9}
    assert got.keys() == want.keys() and all(got[k] == v or abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert stats.bh_adjust(spark.createDataFrame([], "p double")).count() == 0


def test_numbers_are_dense_and_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit("x")).alias("g"), F.col("id").alias("u"))
    a = {(r["g"], r["u"]): (r["_pos"], r["_n"]) for r in ranks.numbered(df, ["g"], "u").collect()}
    b = {(r["g"], r["u"]): (r["_pos"], r["_n"]) for r in ranks.numbered(df.repartition(7), ["g"], "u").collect()}
    assert a == b
    for g in ("x", None):
        mine = [v for (k, _), v in a.items() if k == g]
        assert sorted(p for p, _ in mine) == list(range(len(mine))) and {n for _, n in mine} == {len(mine)}


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(1)
    groups = {
        "one": [3.0], "two": [1.0, 4.0], "normal": rng.normal(size=7000), "tail": np.exp(rng.normal(size=5000) * 20), "ties": rng.integers(0, 3, 6000).astype(float),
        "same": np.full(3000, 2.5), "ends": np.concatenate([rng.normal(size=500), [np.inf, -np.inf, 1e308, -1e308]]), None: rng.random(900),
    }
    qs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.95, 1.0]
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("two", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", qs, accuracy=accuracy).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        inner = [k for k, q in enumerate(qs) if g != "ends" or 0.1 < q < 1]
        assert np.allclose(np.array(got[g]["q"])[inner], np.quantile(np.array(vs), np.array(qs)[inner]), rtol=1e-9), g
    whole = ranks.quantiles(df.where("g = 'normal'"), [], "v", [0.25, 0.75], accuracy=accuracy).first()
    assert np.allclose(whole["q"], np.quantile(groups["normal"], [0.25, 0.75]))


def test_quantiles_keep_few_values(spark):
    """Beyond the summaries' size only values near the quantiles are counted one by one."""
    df = spark.range(0, 200_000, 1, 8).select((F.rand(3) * 100).alias("v"))
    out = ranks.quantiles(df, [], "v", [0.5], accuracy=1000)
    assert abs(out.first()["q"][0] - np.quantile([r["v"] for r in df.collect()], 0.5)) < 1e-9
    edges = df.agg(F.percentile_approx("v", [0.498, 0.502], 1000).alias("e")).first()["e"]
    assert df.where(F.col("v").between(*edges)).count() < 2000  # of 200,000


def brute_silhouettes(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = np.zeros(len(x))
    for i in range(len(x)):
        mine = label == label[i]
        if mine.sum() > 1:
            a = d[i, mine].sum() / (mine.sum() - 1)
            b = min(d[i, label == g].mean() for g in set(label.tolist()) if g != label[i])
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def test_silhouettes_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 3)) + rng.integers(0, 4, 2000)[:, None]
    x[7] = x[8]  # repeated rows
    label = rng.integers(0, 5, 2000)
    label[11] = 9  # a cluster of one
    rows = [(k, int(c), v.tolist()) for k, (c, v) in enumerate(zip(label, x, strict=True))] + [(5000, None, [0.0] * 3), (5001, 1, None)]
    df = spark.createDataFrame(rows, "id int, c int, v array<double>").repartition(6)
    want = brute_silhouettes(x, label)
    got = {r["id"]: r["silhouette"] for r in learn.silhouettes(df, "id", "v", "c").collect()}
    assert len(got) == 2000 and np.allclose([got[k] for k in range(2000)], want, atol=1e-9) and got[11] == 0.0
    some = {r["id"]: r["silhouette"] for r in learn.silhouettes(df, "id", "v", "c", most=150).collect()}
    assert len(some) == 150 and all(abs(s - want[k]) < 1e-9 for k, s in some.items())
    assert abs(learn.silhouette(df, "id", "v", "c") - want.mean()) < 1e-9
    with pytest.raises(ValueError, match="two clusters"):
        learn.silhouettes(df.where("c = 1"), "id", "v", "c")


def test_given_models(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [3, 0] + [1, 7]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id int, a double, b double")
    scales = learn.fitted_scales(df, ["a", "b"])
    assert [(r["name"], round(r["std"], 9)) for r in scales.collect()] == [("a", round(x[:, 0].std(), 9)), ("b", 1.0)]
    out = learn.assigned(learn.projected(df, ["a", "b"], scales, [[2.0, 1.0]]), "scores", [[-2.0], [2.0], [2.0]], distance="far").orderBy("id").collect()
    s = 2 * (x[:, 0] - x[:, 0].mean()) / x[:, 0].std() + (x[:, 1] - x[:, 1].mean())
    assert np.allclose([r["scores"][0] for r in out], s)
    assert [r["cluster"] for r in out] == [int(abs(v - 2) < abs(v + 2)) for v in s]
    assert np.allclose([r["far"] for r in out], np.minimum(abs(s - 2), abs(s + 2)))


@pytest.mark.parametrize("statistic", ["mean", "median"])
def test_permutation_tests_of_all_sizes_agree(spark, monkeypatch, statistic):
    """In one row, by cells of the draws, and by sorting every repetition."""
    rng = np.random.default_rng(4)
    rows = [(g, k, "a" if rng.random() < 0.3 else "b", float(rng.normal())) for g, n in (("x", 300), (None, 40), ("y", 7)) for k in range(n)] + [("z", 1, "a", 1.0), ("x", 9999, "a", None)]
    df = spark.createDataFrame(rows, "g string, u int, arm string, v double")
    test = lambda s: {r["g"]: (r["n_a"], r["n_b"], r["p"]) for r in stats.permutation_test(df, ["g"], "u", "v", "arm", 120, s).collect()}
    by_windows = test(stats.STATISTICS[statistic])
    assert by_windows["z"][2] is None and set(by_windows) == {"x", "y", "z", None}
    assert test(statistic) == by_windows
    monkeypatch.setattr(stats, "SMALL_TEST", 50)
    monkeypatch.setattr(stats, "CELL_BITS", 4)
    assert test(statistic) == by_windows


def test_large_tests_broadcast_no_draws(spark, monkeypatch):
    """Only tables of tests are broadcast; draws, a row a unit and repetition, never are."""
    rng = np.random.default_rng(5)
    rows = [(g, k, "a" if k % 3 else "b", float(rng.normal())) for g in "xy" for k in range(900)]
    monkeypatch.setattr(stats, "SMALL_TEST", 100)
    df = spark.createDataFrame(rows, "g string, u int, arm string, v double")
    out = stats.permutation_test(df, ["g"], "u", "v", "arm", 50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert [part for part in plan.split("BroadcastExchange")[1:] if "md5" in part.split("Join")[0]] == []
    by_windows = stats.permutation_test(df, ["g"], "u", "v", "arm", 50, stats.STATISTICS["mean"])
    assert {tuple(r) for r in out.select("g", "n_a", "p").collect()} == {tuple(r) for r in by_windows.select("g", "n_a", "p").collect()}


@pytest.mark.parametrize("n_a, size", [(1, 20_001), (300, 30_000), (15_000, 30_000), (29_999, 30_000)])
def test_the_border_of_an_arm_lies_between_its_bounds(spark, n_a, size):
    low, high = spark.range(1).select(*stats.near_bounds(F.lit(n_a), F.lit(size))).first()
    low, high = int(low, 16), int(high, 16) if high else 2**32
    rng = np.random.default_rng(6)
    for _ in range(200):
        at = np.sort(rng.integers(0, 2**32, size))[n_a - 1]
        assert low <= at < high
    assert (high - low) / 2**32 * size < 20 * n_a**0.5 + 100


def test_silhouettes_return_every_row_of_more_than_ten_thousand(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(10_300, 9))
    x[5000:5020] = x[0]  # copies, whose distance is 0
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "c": np.arange(len(x)) % 3, "v": x.tolist()})).repartition(4)
    got = learn.silhouettes(df, "id", "v", "c").toPandas().sort_values("id")
    assert len(got) == len(x)
    d = np.sqrt(((x[5000] - x) ** 2).sum(axis=1))
    c = np.arange(len(x)) % 3
    means = [d[c == k].sum() / ((c == k).sum() - (k == c[5000])) for k in range(3)]
    assert abs(got["own"].iloc[5000] - means[c[5000]]) < 1e-9 and abs(got["other"].iloc[5000] - min(m for k, m in enumerate(means) if k != c[5000])) < 1e-9


def test_bootstrap_draws_are_neither_broadcast_nor_made_in_one_task(spark):
    df = spark.range(0, 300, 1, 1).select("id", (F.col("id") % 3).alias("bin"), (F.col("id") * 1.5).alias("v"))
    for out in (stats.bootstrap_band(df, "id", "bin", "v", 20), stats.bootstrap_reps(df, ["bin"], "id", "v", 20)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert [part for part in plan.split("BroadcastExchange")[1:] if "Generate explode" in part.split("Join")[0]] == []
        below = plan.split("Generate explode")[1]
        assert "RoundRobinPartitioning(4)" in below.split("Join")[0]


def test_all_settings_of_a_sweep_meet_the_pairs_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 2)) + 6 * rng.integers(0, 2, 1500)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, v array<double>")
    plans, made = [], learn.distance_sums

    def sums(*args):
        plans.append(made(*args))
        return plans[-1]

    monkeypatch.setattr(learn, "distance_sums", sums)
    best = learn.sweep(df, "id", "v", [2, 3, 5], [0, 1], 6).collect()
    assert len(plans) == 1 and len(best) == 6
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    for r in best:
        label = np.array([c["cluster"] for c in learn.clusters(df, "v", r["k"], r["seed"]).orderBy("id").collect()])
        assert abs(r["silhouette"] - brute_silhouettes(x, label).mean()) < 1e-9


@pytest.mark.parametrize("runs", [0, 24])
def test_silhouettes_of_several_clusterings(spark, monkeypatch, runs):
    """Clusters of any type, one row alone, one cluster only, missing rows; far from the origin, with copies, and clusters that lie in runs or not."""
    monkeypatch.setattr(learn, "FEW_RUNS", runs)
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1300, 3)) + 1e6 * rng.integers(0, 2, 1300)[:, None]
    x[40:60] = x[7]
    a, b = rng.integers(0, 40, 1300), rng.choice(["p", "q"], 1300)
    a[3] = 77
    rows = [(k, int(c), str(d), "all", v.tolist()) for k, (c, d, v) in enumerate(zip(a, b, x, strict=True))] + [(2000, 1, None, "all", [0.0] * 3), (2001, 1, "p", "all", None)]
    df = spark.createDataFrame(rows, "id int, a int, b string, one string, v array<double>").repartition(4)
    got = learn.mean_silhouettes(df, "id", "v", ["a", "one", "b"])
    assert got[1] is None
    assert abs(got[0] - brute_silhouettes(x, a).mean()) < 1e-9 and abs(got[2] - brute_silhouettes(x, b).mean()) < 1e-9
    assert learn.mean_silhouettes(df, "id", "v", ["one"]) == [None]


def test_distances_that_cancel_are_differences():
    rng = np.random.default_rng(11)
    y = rng.normal(size=(200, 5)) * 1e-3 + 1e5 * rng.integers(0, 2, 200)[:, None]
    few = np.concatenate([rng.normal(size=(190, 5)) * 1e5, y[:10]])
    for x in (y, few, y[:1]):
        want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        assert np.allclose(learn.distances(x, y), want, rtol=1e-9, atol=0)
    x = np.array([[np.inf, 0.0], [1.0, 2.0], [np.nan, 0.0]])
    y = np.array([[0.0, 0.0], [4.0, 6.0]])
    with np.errstate(invalid="ignore"):
        got = learn.distances(x, y)
        back = learn.distances(y, x)
    assert np.isinf(got[0]).all() and np.allclose(got[1], [5**0.5, 5.0]) and np.isnan(got[2]).all()
    assert np.allclose(back[:, 1], [5**0.5, 5.0])

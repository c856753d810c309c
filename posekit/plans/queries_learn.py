"""ML1-ML6, SG1, SG2, O7."""

from pyspark.sql import functions as F

from posekit.operators import filters, learn, signal
from posekit.plans.queries_filters import embedded
from posekit.plans.registry import query

XY = [f"{a}_{n}_fly" for n in range(4) for a in "xy"]


@query("ml1_standardised", "embeddings", "SELECT vec_id, " + ", ".join(f"(v{k} - avg(v{k}) OVER ()) / CASE WHEN stddev_pop(v{k}) OVER () = 0 THEN 1 ELSE stddev_pop(v{k}) OVER () END AS s{k}" for k in range(8)) + " FROM (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS v{k}" for k in range(8)) + " FROM embeddings)", " ".join(f"s{k}" for k in range(8)))
def ml1(emb):
    out = learn.standardised(embedded(emb).select("vec_id", *XY), XY)
    return out.toDF("vec_id", *[f"s{k}" for k in range(8)])


@query("ml2_principal_components", "embeddings")
def ml2(emb):
    wide = embedded(emb)
    cols = [c for c in wide.columns if c[:2] in ("x_", "y_")]
    scores, shares = learn.principal_components(wide.select("vec_id", "label", *cols), cols, 0.95)
    return scores.withColumn("n_components", F.lit(len(shares)))


def scored(emb, k=4):
    wide = embedded(emb)
    return learn.principal_components(wide.select("vec_id", "label", *XY), XY, k=k)[0]


@query("ml3_clusters", "embeddings")
def ml3(emb):
    return learn.clusters(scored(emb), "scores", 12).select("vec_id", "label", "cluster")


VECTORS = "(SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS f FROM embeddings WHERE label IS NOT NULL)"
SILHOUETTE = f"""SELECT vec_id, label, own, other, CASE WHEN own IS NULL OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END AS silhouette FROM (
  SELECT vec_id, label, max(CASE WHEN c = label THEN total / nullif(n - 1, 0) END) AS own, min(CASE WHEN c <> label THEN total / n END) AS other FROM (
    SELECT a.vec_id, a.label, b.label AS c, sum(list_distance(a.f, b.f)) AS total, count(*) AS n FROM {VECTORS} a CROSS JOIN {VECTORS} b GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def vectors(emb):
    return emb.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("f"))


@query("ml4_silhouette", "embeddings", SILHOUETTE, "own other silhouette")
def ml4(emb):
    """Euclidean silhouettes of the given labels, every row against all rows."""
    return learn.silhouettes(vectors(emb), "vec_id", "f", "label")


@query("ml5_sweep", "embeddings")
def ml5(emb):
    return learn.sweep(scored(emb), "vec_id", "scores", [4, 8, 12], [0, 1], 5)


@query("o7_best_settings", "embeddings")
def o7(emb):
    return learn.sweep(scored(emb, 2), "vec_id", "scores", [3, 6], [0], 1)


#: A given model: loadings of two components over XY, and centres among the scores.
LOADINGS = [[0.5, 0.1, -0.4, 0.3, 0.2, -0.6, 0.25, 0.15], [-0.2, 0.45, 0.3, 0.1, -0.5, 0.2, 0.4, -0.35]]
CENTRES = [[x, y] for x in (-0.8, 0.0, 0.8) for y in (-0.6, 0.6)]
Z_SQL = "(SELECT vec_id, label, " + ", ".join(f"(v{k} - avg(v{k}) OVER ()) / coalesce(nullif(stddev_pop(v{k}) OVER (), 0), 1) AS z{k}" for k in range(8)) + " FROM (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS v{k}" for k in range(8)) + " FROM embeddings))"
SCORES_SQL = "(SELECT vec_id, label, " + ", ".join(" + ".join(f"z{k} * ({w})" for k, w in enumerate(row)) + f" AS s{c}" for c, row in enumerate(LOADINGS)) + f" FROM {Z_SQL})"
ASSIGNED_SQL = f"(SELECT vec_id, label, s0, s1, min_by(c, (d, c)) AS cluster, sqrt(min(d)) AS far FROM (SELECT *, (s0 - x) ** 2 + (s1 - y) ** 2 AS d FROM {SCORES_SQL} CROSS JOIN (VALUES {', '.join(f'({k}, {x}, {y})' for k, (x, y) in enumerate(CENTRES))}) AS t(c, x, y)) GROUP BY 1, 2, 3, 4)"


def by_model(emb):
    """Scores and clusters of all rows by the given model; its scales are fitted on them."""
    wide = embedded(emb).select("vec_id", "label", *XY)
    scores = learn.projected(wide, XY, learn.fitted_scales(wide, XY), LOADINGS)
    return learn.assigned(scores, "scores", CENTRES, distance="far")


@query("ml3_assigned", "embeddings", f"SELECT vec_id, label, cluster, far FROM {ASSIGNED_SQL}", "far")
def ml3b(emb):
    return by_model(emb).select("vec_id", "label", "cluster", "far")


#: Given settings, as many centres each, for a choice by silhouette.
SETTINGS = {"two": CENTRES[1:5:3], "four": CENTRES[:4], "six": CENTRES}


def _setting_sql(name: str) -> str:
    near = f"(SELECT vec_id, s0, s1, min_by(c, (d, c)) AS cluster FROM (SELECT *, (s0 - x) ** 2 + (s1 - y) ** 2 AS d FROM {SCORES_SQL} CROSS JOIN (VALUES {', '.join(f'({k}, {x}, {y})' for k, (x, y) in enumerate(SETTINGS[name]))}) AS t(c, x, y)) GROUP BY 1, 2, 3)"
    sums = f"SELECT a.vec_id, a.cluster, b.cluster AS c, sum(sqrt((a.s0 - b.s0) ** 2 + (a.s1 - b.s1) ** 2)) AS total, count(*) AS n FROM {near} a CROSS JOIN {near} b GROUP BY 1, 2, 3"
    each = f"SELECT vec_id, max(CASE WHEN c = cluster THEN total / nullif(n - 1, 0) END) AS own, min(CASE WHEN c <> cluster THEN total / n END) AS other FROM ({sums}) GROUP BY 1"
    return f"SELECT '{name}' AS setting, avg(CASE WHEN own IS NULL OR greatest(own, other) = 0 THEN 0 ELSE (other - own) / greatest(own, other) END) AS silhouette FROM ({each})"


@query("o7_scored_settings", "embeddings", f"SELECT setting, silhouette FROM ({' UNION ALL '.join(map(_setting_sql, SETTINGS))}) ORDER BY silhouette DESC LIMIT 2", "silhouette")
def o7b(emb):
    """The two best of given settings by the exact silhouette of their clusters."""
    rows = by_model(emb).select("vec_id", "scores")
    for name, centres in SETTINGS.items():
        rows = learn.assigned(rows, "scores", centres, name)
    got = list(zip(SETTINGS, learn.mean_silhouettes(rows, "vec_id", "scores", list(SETTINGS)), strict=True))
    return emb.sparkSession.createDataFrame(got, "setting string, silhouette double").orderBy(F.desc("silhouette"), "setting").limit(2)


@query("ml6_projected", "embeddings", f"SELECT vec_id, label, s0 AS map_x, s1 AS map_y FROM {SCORES_SQL}", "map_x map_y")
def ml6b(emb):
    return by_model(emb).select("vec_id", "label", F.col("scores")[0].alias("map_x"), F.col("scores")[1].alias("map_y"))


@query("ml6_behaviour_map", "embeddings")
def ml6(emb):
    """Two scores an event with its metadata: chosen feature groups, gaps as 9999."""
    wide = embedded(emb)
    cols = filters.feature_columns(wide.columns, {"x": "^x_[0-9]_", "y": "^y_[0-9]_"}, ["x", "y"])
    filled = wide.select("vec_id", "label", *cols).na.fill(9999.0, cols)
    return learn.principal_components(filled, cols, k=2)[0].select("vec_id", "label", F.col("scores")[0].alias("map_x"), F.col("scores")[1].alias("map_y"))


@query("sg1_butterworth", "frames")
def sg1(frames):
    return signal.low_pass(frames, ["recording", "track"], "frame", "x", *signal.butterworth(3, 0.2))


@query("sg2_chebyshev", "frames")
def sg2(frames):
    return signal.low_pass(frames, ["recording", "track"], "frame", "x", *signal.chebyshev1(3, 0.5, 0.2))

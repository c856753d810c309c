"""F1-F23."""

from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.operators import filters as O
from posekit.plans.registry import query

KEY = ["recording", "track", "frame"]


@query("f1_time_range", "frames", "SELECT recording, track, frame, time FROM frames WHERE time >= 100 AND time <= 900", "time")
def f1(frames):
    return O.time_range(frames, 100.0, 900.0).select(*KEY, "time")


@query("f2_exclude_values", "frames", "SELECT recording, track, frame, x FROM frames WHERE x IS NULL OR x NOT IN (10.0, 20.0, 30.0)", "x")
def f2(frames):
    return O.exclude_values(frames, "x", [10.0, 20.0, 30.0]).select(*KEY, "x")


@query("f3_equals", "ev", "SELECT fly, event_id FROM ev WHERE event_type = 'view'")
def f3(ev):
    return O.equals(ev, "event_type", "view").unionByName(O.equals(ev, "nickname", "none")).select("fly", "event_id")


@query("f4_members", "ev", "SELECT event_id, cluster IN (1, 3, 5) AS inside FROM ev")
def f4(ev):
    inside, outside = O.members(ev, "cluster", [1, 3, 5]), O.members(ev, "cluster", [1, 3, 5], complement=True)
    return inside.select("event_id", F.lit(True).alias("inside")).union(outside.select("event_id", F.lit(False)))


@query("f5_name_predicates", "names", "SELECT id, regexp_matches(name, 'g|z') AS has_letter, (contains(lower(name), 'brand') AND contains(lower(name), 'ring')) AS has_all FROM names")
def f5(names):
    return names.select("id", F.col("name").rlike("g|z").alias("has_letter"), S.contains_all("name", ["Brand", "Ring"]).alias("has_all"))


@query("f6_without_tokens", "paths", "SELECT page_id FROM paths WHERE NOT (contains(lower(path), 'spam') OR contains(lower(path), '/de/'))")
def f6(paths):
    return O.without_tokens(paths, "path", ["SPAM", "/de/"]).select("page_id")


@query("f7_at_most_tracks", "frames", "SELECT recording, track, frame FROM frames WHERE recording IN (SELECT recording FROM frames GROUP BY 1 HAVING count(DISTINCT track) <= 15)")
def f7(frames):
    return O.at_most_tracks(frames, 15).select(*KEY)


@query("f8_clean", "frames", "SELECT recording, track, frame, x FROM frames WHERE x IS NOT NULL AND grp IS NOT NULL", "x")
def f8(frames):
    return O.clean(frames, "x", "grp").select(*KEY, "x")


@query("f9_groups_like", "names", "SELECT id, genotype FROM names WHERE genotype IN ('ECONOMY') OR contains(genotype, 'MA')")
def f9(names):
    return O.groups_like(names, "genotype", ["ECONOMY"], ["MA"]).select("id", "genotype")


@query("f10_reaches", "frames", "SELECT recording, track, frame FROM frames WHERE track IN (SELECT track FROM frames GROUP BY 1 HAVING bool_or(x >= 98))")
def f10(frames):
    return O.reaches(frames, "track", F.col("x") >= 98).select(*KEY)


@query("f11_long_enough", "frames", "SELECT recording, track, frame FROM frames WHERE track IN (SELECT track FROM frames GROUP BY 1 HAVING max(time) >= 1690)")
def f11(frames):
    return O.long_enough(frames, "track", 1690.0).select(*KEY)


def embedded(emb):
    """Embeddings as one column a component."""
    return emb.select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"{'xy'[k % 2]}_{k // 2}_fly" if k < 60 else f"centre_{k}") for k in range(64)])


X_COLUMNS = ", ".join(f"CAST(embedding[{2 * n + 1}] AS DOUBLE) AS x_{n}_fly" for n in range(30))


@query("f12_feature_columns", "embeddings", f"SELECT vec_id, {X_COLUMNS}, CAST(embedding[4] AS DOUBLE) AS y_1_fly FROM embeddings")
def f12(emb):
    wide = embedded(emb)
    return wide.select("vec_id", *O.feature_columns(wide.columns, {"x": "^x_", "y": "^y_"}, ["x"], also=["centre", "y_1_"]))


@query("f13_numeric_split", "ev", "SELECT fly, cluster, displacement, light, concat_ws('|', event_type, event_id, ts) AS metadata FROM ev")
def f13(ev):
    numeric, other = O.numeric_split(ev, ["event_id"])
    return ev.select(*numeric, F.concat_ws("|", *[F.col(c).cast("string") for c in other]).alias("metadata"))


@query("f14_columns_matching", "embeddings", f"SELECT {X_COLUMNS} FROM embeddings")
def f14(emb):
    return O.columns_matching(embedded(emb), "^x_.*_fly$")


@query("f15_first_of_repeated_columns", "ev", "SELECT fly, event_id, displacement FROM ev")
def f15(ev):
    return O.first_of_repeated_columns(ev.select("fly", "event_id", "fly", F.col("cluster").alias("event_id"), "displacement"))


@query("f16_resolve_node", "points", "SELECT recording, track, frame, x FROM points WHERE node = 'thorax'", "x")
def f16(points):
    return points.where(F.col("node") == O.resolve_node(["head", "thorax", "abdomen"], "Thorax")).select(*KEY, "x")


@query("f17_presence", "points", "SELECT recording, track, frame, max(x IS NOT NULL OR y IS NOT NULL) AS present FROM points GROUP BY 1, 2, 3")
def f17(points):
    return O.presence(points, KEY)


@query("f18_score_filter", "points", "SELECT recording, track, frame, node FROM points WHERE score >= 0.3")
def f18(points):
    return points.where(F.col("score") >= 0.3).select(*KEY, "node")


@query("f19_first_events", "ev", "SELECT event_id, displacement FROM ev WHERE event_id < 100 AND displacement > 0", "displacement")
def f19(ev):
    return ev.where((F.col("event_id") < 100) & (F.col("displacement") > 0)).select("event_id", "displacement")


@query("f20_scopes", "frames", "SELECT 'shared' AS scope, recording, track, frame FROM frames WHERE time <= 360.5 UNION ALL SELECT 'long', recording, track, frame FROM frames WHERE recording % 2 = 0")
def f20(frames):
    shared, long = O.scopes(frames, 360.5, F.col("recording") % 2 == 0)
    return shared.select(F.lit("shared").alias("scope"), *KEY).union(long.select(F.lit("long"), *KEY))


@query("f21_without_start", "frames", "SELECT recording, track, frame FROM frames WHERE frame > 20")
def f21(frames):
    return O.without_start(frames, 20, ["recording", "track"]).select(*KEY)


@query("f22_normalise_values", "ev", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing' ELSE event_type END AS kind FROM ev")
def f22(ev):
    return ev.na.replace({"error": "missing"}, subset=["event_type"]).select("event_id", F.col("event_type").alias("kind"))


@query("f23_retry_groups", "names", "SELECT id, genotype FROM names WHERE genotype IN (SELECT genotype FROM names WHERE genotype = 'SMALL' OR name = 'blue bolt (Brand#4)' OR CAST(id AS STRING) = '7')")
def f23(names):
    listed = names.sparkSession.createDataFrame([("# Missing videos",), ("- SMALL",), ("blue bolt (Brand#4)",), ("",)], "value string")
    pairs = names.where(F.col("id") == 7).select("genotype").distinct().select(F.col("genotype").alias("item"))
    return O.retry_groups(names, "genotype", "name", O.missing_list(listed).union(pairs)).select("id", "genotype")

"""S1-S14."""

from pyspark.sql import functions as F

from posekit.plans.queries_joins import files
from posekit.plans.registry import query
from posekit.sources import io as O

FPS = 80.0
TENSOR_SQL = "(SELECT vec_id // 10 AS recording, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS frame, embedding, unnest(range(0, 32)) AS n FROM embeddings)"
POINT_SQL = f"SELECT recording, {{t}} AS track_id, frame, frame / 80.0 AS time, 'node' || CAST(n{{off}} AS STRING) AS node, CAST(embedding[2 * n + 1] AS DOUBLE) AS x, CAST(embedding[2 * n + 2] AS DOUBLE) AS y FROM {TENSOR_SQL}"


def tensors(emb):
    """Ten vectors a recording: two tracks of 16 nodes, ten frames; position p is node p / 2, axis p % 2."""
    rec = emb.groupBy(F.expr("vec_id div 10").alias("recording")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("fs"))

    def axis(track: int, a: int):
        return F.transform(F.sequence(F.lit(16 * track), F.lit(16 * track + 15)), lambda n: F.transform("fs", lambda f: F.get(f["embedding"], 2 * n + a).cast("double")))

    return rec.select("recording", F.array(*[F.array(axis(t, 0), axis(t, 1)) for t in (0, 1)]).alias("tracks"), F.array(*[F.lit(f"node{k}") for k in range(16)]).alias("node_names"), F.array(F.lit("first")).alias("track_names"))


@query("s1_track_tables", "embeddings", f"SELECT recording, CASE WHEN n < 16 THEN 'first' ELSE 'track_2' END AS track_id, CASE WHEN n < 16 THEN 'fly_first' ELSE 'fly_2' END AS object, frame, frame / 80.0 AS time, 'node' || CAST(n % 16 AS STRING) AS node, CAST(embedding[2 * n + 1] AS DOUBLE) AS x, CAST(embedding[2 * n + 2] AS DOUBLE) AS y FROM {TENSOR_SQL}", "time x y")
def s1(emb):
    return O.explode_tensor(tensors(emb), FPS)


@query("s2_single_object", "embeddings", f"SELECT recording, frame, 'node' || CAST(n AS STRING) AS node, CAST(embedding[2 * n + 1] AS DOUBLE) AS x, CAST(embedding[2 * n + 2] AS DOUBLE) AS y FROM {TENSOR_SQL} WHERE n < 16", "x y")
def s2(emb):
    return O.single_object(tensors(emb), FPS).select("recording", "frame", "node", "x", "y")


@query("s3_node_positions", "points", "SELECT recording, track, count(*) AS n, list_sum(list_transform(list(CAST(x AS DOUBLE) ORDER BY frame), lambda v: coalesce(v, 0.0))) AS total FROM points WHERE node = 'head' GROUP BY 1, 2", "total")
def s3(points):
    p = O.node_positions(points, "head", ["recording", "track"])
    return p.select("recording", "track", F.size("positions").cast("long").alias("n"), F.aggregate("positions", F.lit(0.0), lambda a, r: a + F.coalesce(r["x"], F.lit(0.0))).alias("total"))


@query("s4_optional_scores", "points", "SELECT recording, track, frame, node, CASE WHEN frame % 2 = 0 THEN score END AS score, CAST(NULL AS DOUBLE) AS none FROM points", "score")
def s4(points):
    keys = ["recording", "track", "frame", "node"]
    bare = points.drop("score")
    out = O.with_scores(bare, points.where("frame % 2 = 0"), keys)
    return O.with_scores(out.withColumnRenamed("score", "s"), None, keys).select(*keys, F.col("s").alias("score"), F.col("score").alias("none"))


@query("s5_repaired_paths", "paths", "SELECT p.page_id, coalesce(i.path, s.path) AS source FROM (SELECT *, CASE WHEN path LIKE 'http://%' THEN 'https://' || substr(path, 8) ELSE path END AS fixed, regexp_replace(regexp_replace(path, '\\.[^./]*$', ''), '_tracked$', '') AS stem FROM paths) p LEFT JOIN (SELECT DISTINCT path FROM paths WHERE page_id % 3 > 0) i ON p.fixed = i.path LEFT JOIN (SELECT regexp_replace(regexp_replace(path, '\\.[^./]*$', ''), '_tracked$', '') AS stem, min(path) AS path FROM paths WHERE page_id % 3 > 0 GROUP BY 1) s ON p.stem = s.stem")
def s5(paths):
    have = paths.where("page_id % 3 > 0")
    return O.repaired_paths(paths, {"http://": "https://"}, have).select("page_id", "source")


@query("s6_csv_columns", "frames", "SELECT x FROM frames", "x")
def s6(frames):
    path = O.fresh_path(frames.sparkSession, "csv")
    O.write_csv(frames.select("track", "frame", "x"), path)
    return O.read_csv(frames.sparkSession, path, "track long, frame int, x double", "^x$")


@query("s7_tables_by_group", "frames", "SELECT grp, track, frame, x FROM frames WHERE grp = 'PG2'", "x")
def s7(frames):
    path = O.fresh_path(frames.sparkSession, "table")
    O.write_table(frames.select("grp", "track", "frame", "x"), path, partition_by=["grp"])
    return frames.sparkSession.read.parquet(path).where("grp = 'PG2'")


@query("s8_inventory", "paths", "SELECT DISTINCT path FROM paths WHERE regexp_matches(path, '(?i)(\\.HTML$|utm_source)') AND NOT regexp_matches(path, 'spam')")
def s8(paths):
    return O.matching(paths, [r"\.HTML$", "utm_source"], ["SPAM"]).select("path")


@query("s10_metadata_rows", "events", "SELECT event_id, 'Arena' || CAST(a AS STRING) AS arena, CAST(CAST(json_extract(props, '$.k') AS INT) + a AS STRING) AS k, event_type AS pretraining FROM events CROSS JOIN (SELECT 1 AS a UNION ALL SELECT 2)")
def s10(events):
    k = F.get_json_object("props", "$.k").cast("int")
    arena = lambda n: F.array((k + n).cast("string"), F.col("event_type"))
    text = F.to_json(F.struct(F.array(F.lit("K"), F.lit("Pretraining")).alias("Variable"), arena(1).alias("Arena1"), arena(2).alias("Arena2")))
    out = O.metadata_rows(events.select("event_id", text.alias("t")), "t", ["event_id"])
    return out.select("event_id", "arena", F.col("metadata")["k"].alias("k"), F.col("metadata")["pretraining"].alias("pretraining"))


@query("s11_metadata_rename", "events", "SELECT event_id, event_type AS pretraining FROM events")
def s11(events):
    text = F.to_json(F.struct(F.array(F.lit("Pretrained")).alias("Variable"), F.array("event_type").alias("Arena1")))
    out = O.metadata_rows(events.select("event_id", text.alias("t")), "t", ["event_id"], {"Pretrained": "Pretraining"})
    return out.select("event_id", F.col("metadata")["pretraining"].alias("pretraining"))


@query("s12_table_sink", "ev", "SELECT cluster, count(*) AS n FROM ev GROUP BY 1")
def s12(ev):
    path = O.fresh_path(ev.sparkSession, "sink")
    O.write_table(ev.groupBy("cluster").agg(F.count("*").alias("n")), path)
    return ev.sparkSession.read.parquet(path)


@query("s13_csv_sink", "ev", "SELECT cluster, count(*) AS n FROM ev GROUP BY 1")
def s13(ev):
    path = O.fresh_path(ev.sparkSession, "sink")
    O.write_csv(ev.groupBy("cluster").agg(F.count("*").alias("n")), path)
    return O.read_csv(ev.sparkSession, path, "cluster long, n long")


@query("s14_unfinished", "paths", "SELECT page_id FROM paths WHERE NOT (page_id % 4 IN (0, 2))")
def s14(paths):
    i = F.col("page_id")
    stem = F.concat(F.lit("clip"), i.cast("string"))
    ends = F.when(i % 4 == 0, F.array(F.lit(".slp"), F.lit(".h5"))).when(i % 4 == 1, F.array(F.lit(".slp"))).when(i % 4 == 2, F.array(F.lit(".empty"))).otherwise(F.array().cast("array<string>"))
    outputs = paths.select(F.explode(ends).alias("e"), stem.alias("s")).select(F.concat(F.lit("/out/"), "s", F.lit("_tracked"), "e").alias("path"))
    return O.unfinished(paths.select("page_id", stem.alias("stem")), outputs).select("page_id")

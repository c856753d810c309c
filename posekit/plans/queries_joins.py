"""J1-J19."""

from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.operators import joins as O
from posekit.operators import naming as N
from posekit.plans.registry import query

KEY = ["recording", "track", "frame"]
PATHS = "(SELECT page_id, path, size, regexp_extract(path, '^https?://([^/]+)', 1) AS folder, regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS name FROM paths)"


def files(paths):
    """Page addresses as files: host as folder, last number as name."""
    return paths.select("page_id", "path", "size", F.regexp_extract("path", r"^https?://([^/]+)", 1).alias("folder"), F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1).alias("name"))


#: A recording of at most ten tracks, so that pairs within one grow with the tracks.
TEN = "CAST((track - track % 10) / 10 AS INT)"


@query("j1_side_by_side", "frames", f"SELECT a.ten AS recording, a.frame, a.track AS track_fly, a.x AS x_fly, b.track AS track_ball, b.x AS x_ball FROM (SELECT *, {TEN} AS ten FROM frames WHERE track % 2 = 0) a JOIN (SELECT *, {TEN} AS ten FROM frames WHERE track % 2 = 1) b ON a.ten = b.ten AND a.frame = b.frame", "x_fly x_ball")
def j1(frames):
    """Even beside odd tracks."""
    pick = lambda k: frames.where(F.col("track") % 2 == k).select(F.expr(TEN).alias("recording"), "frame", "track", "x")
    return O.side_by_side(pick(0), pick(1), ["recording", "frame"], ("_fly", "_ball"))


@query("j2_group_size", "ev", "SELECT event_id, count(displacement) OVER (PARTITION BY event_type) AS n FROM ev")
def j2(ev):
    return O.with_group_size(ev, ["event_type"], "displacement").select("event_id", "n")


@query("j3_proportions", "ev", "SELECT cluster, light, c.n AS count, t.n AS total, c.n / t.n AS proportion FROM (SELECT cluster, light, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY 1, 2) c LEFT JOIN (SELECT cluster, count(*) AS n FROM ev GROUP BY 1) t USING (cluster)", "proportion")
def j3(ev):
    return O.proportions(ev.where("event_type = 'view'").groupBy("cluster", "light").count(), ev.groupBy("cluster").agg(F.count("*").alias("total")), ["cluster"])


@query("j4_interval_labels", "frames pulses", "SELECT recording, track, frame, p.on_index IS NOT NULL AS stim_on, p.on_index FROM frames f LEFT JOIN pulses p ON p.seq = 'long' AND f.time >= p.start_s AND f.time < p.end_s")
def j4(frames, pulses):
    return O.labelled_times(frames, pulses.where("seq = 'long'").drop("seq")).select(*KEY, "stim_on", "on_index")


@query("j5_onset_windows", "frames pulses", "SELECT recording, track, frame, on_index, time - start_s AS rel FROM frames f JOIN pulses p ON p.seq = 'long' AND f.time >= p.start_s - 10 AND f.time < p.start_s + 70", "rel")
def j5(frames, pulses):
    return O.onset_windows(frames, pulses.where("seq = 'long'"), 10.0, 70.0).select(*KEY, "on_index", "rel")


@query("j6_in_cluster", "ev", "SELECT fly, event_type, event_id FROM ev WHERE cluster = 3")
def j6(ev):
    return O.in_cluster(ev.select("fly", "event_type", "event_id"), ev, ["fly", "event_type", "event_id"], 3)


@query("j7_event_metadata", "frames ev", "SELECT f.track AS fly, f.event_type, min(f.frame) AS first_frame, max(f.frame) AS last_frame, concat('rec', max(f.recording)) AS path, max(d.displacement) AS displacement FROM frames f LEFT JOIN (SELECT fly, event_type, max(displacement) AS displacement FROM ev WHERE cluster < 3 GROUP BY 1, 2) d ON f.track = d.fly AND f.event_type = d.event_type GROUP BY 1, 2", "displacement")
def j7(frames, ev):
    rows = frames.select(F.col("track").alias("fly"), "event_type", "frame", F.concat(F.lit("rec"), "recording").alias("path"))
    moved = ev.where("cluster < 3").groupBy("fly", "event_type").agg(F.max("displacement").alias("displacement"))
    return O.event_metadata(rows, ["fly", "event_type"], "path", moved)


CENTROIDS = f"(SELECT {TEN} AS recording, frame, track, avg(x) AS cx, avg(y) AS cy FROM points GROUP BY 1, 2, 3 HAVING avg(x) IS NOT NULL)"


@query("j8_track_pairs", "points", f"SELECT a.recording, a.frame, a.track AS a, b.track AS b, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS d FROM {CENTROIDS} a JOIN {CENTROIDS} b ON a.recording = b.recording AND a.frame = b.frame AND a.track > b.track", "d")
def j8(points):
    centroids = points.withColumn("recording", F.expr(TEN)).groupBy("recording", "frame", "track").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).where("cx IS NOT NULL").withColumn("rank", F.col("track"))
    pairs = O.track_pairs(centroids, ["recording", "frame"])
    return pairs.select("recording", "frame", "a", "b", S.distance("ax", "ay", "bx", "by").alias("d"))


NODES_SQL = "(SELECT recording, track, frame, " + ", ".join(f"max(CASE WHEN node = '{n}' THEN {c} END) AS {c}_{n}" for n in ("head", "thorax", "abdomen") for c in "xy") + " FROM points WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3)"
SEGMENT_SQL = " UNION ALL ".join(f"SELECT recording, track, frame, '{a}' AS src, '{b}' AS dst, sqrt((x_{a} - x_{b}) ** 2 + (y_{a} - y_{b}) ** 2) AS length FROM {NODES_SQL} WHERE x_{a} IS NOT NULL AND x_{b} IS NOT NULL" for a, b in (("head", "thorax"), ("thorax", "abdomen")))


@query("j9_segments", "points", SEGMENT_SQL, "length")
def j9(points):
    return O.segments(points, [("head", "thorax"), ("thorax", "abdomen")], KEY).select(*KEY, "src", "dst", "length")


MAP_SQL = "(SELECT 'small ring' AS k, 'SR' AS v UNION ALL SELECT 'Brand#4', 'B4' UNION ALL SELECT 'HOT GEAR (BRAND#3)', 'HG3' UNION ALL SELECT 'blue bolt (Brand#4)', 'BB4')"


def name_map(spark):
    return spark.createDataFrame([("small ring", "SR"), ("Brand#4", "B4"), ("HOT GEAR (BRAND#3)", "HG3"), ("blue bolt (Brand#4)", "BB4")], "key string, value string")


@query("j10_name_cascade", "names", f"SELECT id, coalesce(e.v, p.v, h.v, l.v, name) AS resolved FROM names LEFT JOIN {MAP_SQL} e ON name = e.k LEFT JOIN {MAP_SQL} p ON regexp_extract(name, '\\(([^()]*)\\)[^()]*$', 1) = p.k LEFT JOIN {MAP_SQL} h ON trim(split_part(name, '(', 1)) = h.k LEFT JOIN {MAP_SQL} l ON lower(name) = lower(l.k)")
def j10(names):
    return N.resolve(names, "id", "name", name_map(names.sparkSession)).select("id", "resolved")


@query("j11_name_map", "names", "SELECT key, max(value) AS value FROM (SELECT name AS key, genotype AS value, 3 AS p FROM names UNION ALL SELECT lower(name), genotype, 2 FROM names WHERE lower(name) NOT IN (SELECT name FROM names) UNION ALL SELECT genotype, genotype, 1 FROM names) GROUP BY key")
def j11(names):
    return N.build_map(names, ["name", "genotype"], "genotype", later_wins=True)


@query("j12_name_match", "names", "SELECT id, CASE WHEN name LIKE 'small%' THEN 'small' WHEN split_part(name, ' ', 1) = 'hot' THEN 'hot' END AS matched FROM names")
def j12(names):
    keys = names.sparkSession.createDataFrame([("small", 0), ("hot", 1)], "stem string, map int")
    return N.match_prefix(names, "id", "name", keys).select("id", "matched")


@query("j13_through_new_map", "names", "SELECT id, coalesce(n.v, name) AS value FROM names LEFT JOIN (SELECT genotype, min(name) AS v FROM names WHERE genotype <> 'SMALL' GROUP BY 1) n USING (genotype)")
def j13(names):
    new = names.where("genotype <> 'SMALL'").groupBy("genotype").agg(F.min("name").alias("value"))
    return N.through(names, new, "genotype", "name").select("id", "value")


@query("j14_missing_artifacts", "paths", f"SELECT folder, bool_or(path LIKE '%.html') AS has_a, bool_or(path LIKE '%#%') AS has_b FROM {PATHS} GROUP BY folder HAVING NOT (bool_or(path LIKE '%.html') AND bool_or(path LIKE '%#%'))")
def j14(paths):
    return O.missing_artifacts(files(paths), "folder", {"a": r"\.html$", "b": "#"}).where("NOT (has_a AND has_b)")


@query("j15_upload_plan", "paths", f"SELECT page_id, CASE WHEN size > 10000 THEN 'oversize' WHEN name IN (SELECT name FROM {PATHS} WHERE size < 1500) THEN 'existing' ELSE 'new' END AS state FROM {PATHS}")
def j15(paths):
    f = files(paths)
    return O.upload_plan(f, f.where("size < 1500").select("name"), 10_000).select("page_id", "state")


@query("j16_pooled_control", "units", "SELECT u.track, g.test, CASE WHEN is_control THEN 'b' ELSE 'a' END AS arm FROM units u JOIN (SELECT DISTINCT grp AS test FROM units WHERE NOT is_control) g ON u.is_control OR u.grp = g.test")
def j16(units):
    return O.with_pooled_control(units, "grp", "is_control").select("track", "test", "arm")


@query("j17_companions", "paths", f"SELECT f.folder, n.name, (f.folder, n.name) IN (SELECT (folder, name) FROM {PATHS}) AS found FROM (SELECT DISTINCT folder FROM {PATHS}) f CROSS JOIN (SELECT unnest(['369', '670', '1']) AS name) n")
def j17(paths):
    f = files(paths)
    return O.companions(f, f, ["369", "670", "1"])


@query("j18_matches_by_stem", "paths", f"SELECT r.stem, count(f.path) AS n FROM (SELECT DISTINCT folder AS stem FROM {PATHS}) r LEFT JOIN paths f ON contains(f.path, r.stem) GROUP BY 1")
def j18(paths):
    f = files(paths)
    return O.matches_by_stem(f.select(F.col("folder").alias("stem")).distinct(), f.select(F.col("path").alias("name")))


@query("j19_pair_by_name", "paths", f"SELECT a.page_id AS left_id, b.page_id AS right_id FROM {PATHS} a JOIN {PATHS} b ON a.name = b.name AND a.page_id < b.page_id")
def j19(paths):
    f = files(paths)
    a, b = f.select("name", F.col("page_id").alias("left_id")), f.select("name", F.col("page_id").alias("right_id"))
    return a.join(b, "name").where("left_id < right_id").select("left_id", "right_id")

"""A1, A10-A22, A25-A34 and O1-O9, U1-U5."""

from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.operators import aggregates as A
from posekit.operators import naming as N
from posekit.operators import ordering as R
from posekit.plans.queries_joins import PATHS, files
from posekit.plans.registry import query

BIN12 = "CAST(greatest(ceil((time - mn) / (mx - mn) * 12) - 1, 0) AS INT)"


@query("a1_binned_means", "frames", f"SELECT time_bin, grp, track, avg(x) AS avg_x, median(x) AS median_x FROM (SELECT *, {BIN12} AS time_bin FROM frames, (SELECT min(time) AS mn, max(time) AS mx FROM frames)) GROUP BY 1, 2, 3", "avg_x median_x")
def a1(frames):
    return A.binned_means(frames, "time", "x", "grp", "track", 12)


@query("a10_counts", "ev", "SELECT cluster, event_type, count(*) AS count FROM ev GROUP BY 1, 2")
def a10(ev):
    return A.counts(ev, ["cluster", "event_type"])


SHARES = "SELECT {w}, {v}, n AS count, sum(n) OVER (PARTITION BY {w}) AS total, n / sum(n) OVER (PARTITION BY {w}) AS share FROM (SELECT {w}, {v}, count(*) AS n FROM ev GROUP BY ALL)"


@query("a11_shares", "ev", SHARES.format(w="cluster", v="event_type"), "share")
def a11(ev):
    return A.shares(ev, ["cluster"], "event_type")


@query("a12_shares_by_subject", "ev", f"SELECT * FROM ({SHARES.format(w='cluster, fly', v='event_type')}) WHERE total >= 5", "share")
def a12(ev):
    return A.shares(ev, ["cluster", "fly"], "event_type", least=5)


@query("a13_shares_on_grid", "ev", "SELECT fly, light, cluster, coalesce(n, 0) AS count, coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY fly, light), 0) AS share FROM (SELECT DISTINCT fly FROM ev) CROSS JOIN (SELECT DISTINCT light FROM ev) CROSS JOIN (SELECT DISTINCT cluster FROM ev) LEFT JOIN (SELECT fly, light, cluster, count(*) AS n FROM ev WHERE event_type = 'view' GROUP BY ALL) USING (fly, light, cluster)", "share")
def a13(ev):
    """The whole events' grid, counts of views only."""
    views = A.counts(ev.where("event_type = 'view'"), ["fly", "light", "cluster"])
    return A.grid_shares(R.key_product(ev, ["fly", "light", "cluster"]), views, ["fly", "light"], "cluster")


@query("a14_percent_check", "ev", "SELECT cluster, 100.0 AS percent FROM ev GROUP BY 1", "percent")
def a14(ev):
    return A.shares(ev, ["cluster"], "event_type").groupBy("cluster").agg((F.sum("share") * 100).alias("percent"))


@query("a15_events_per_subject", "ev", "SELECT light, fly, n AS n_events, count(*) OVER (PARTITION BY light) AS n_subjects FROM (SELECT light, fly, count(DISTINCT event_id) AS n FROM ev GROUP BY ALL)")
def a15(ev):
    return A.events_per_subject(ev, "light", "fly", "event_id")


@query("a16_cardinalities", "frames", "SELECT grp, count(DISTINCT track) AS n_track, count(DISTINCT recording) AS n_recording, count(*) AS n FROM frames GROUP BY 1")
def a16(frames):
    return A.cardinalities(frames, "grp", ["track", "recording"])


@query("a17_mean_ci", "ev", "SELECT cluster, avg(displacement) AS mean, count(displacement) AS n, stddev_samp(displacement) AS std, 1.96 * stddev_samp(displacement) / sqrt(count(displacement)) AS ci FROM ev GROUP BY 1", "mean std ci")
def a17(ev):
    return A.mean_ci(ev, ["cluster"], "displacement")


SCORES = "(SELECT cluster, median(displacement) AS score FROM ev WHERE displacement > 0 GROUP BY 1)"


@query("a18_ranked_medians", "ev", "SELECT cluster, score AS median, row_number() OVER (ORDER BY score DESC, cluster) AS rank FROM " + SCORES, "median")
def a18(ev):
    return A.ranked_medians(ev, "cluster", "displacement")


def scores(ev):
    return ev.where("displacement > 0").groupBy("cluster").agg(F.percentile("displacement", F.lit(0.5)).alias("score"))


@query("a19_efficient_share", "ev", f"SELECT light, avg(CASE WHEN score >= mid THEN 100.0 ELSE 0 END) AS efficient, avg(CASE WHEN score < mid THEN 100.0 ELSE 0 END) AS inefficient FROM ev JOIN {SCORES} USING (cluster), (SELECT median(score) AS mid FROM {SCORES}) GROUP BY 1", "efficient inefficient")
def a19(ev):
    return A.efficient_share(ev, scores(ev), "cluster", "light")


@query("a20_weighted_score", "ev", f"SELECT light, avg(coalesce(score, 0)) AS weighted FROM ev LEFT JOIN (SELECT * FROM {SCORES} WHERE cluster <> 4) USING (cluster) GROUP BY 1", "weighted")
def a20(ev):
    return A.weighted_score(ev, scores(ev).where("cluster <> 4"), "cluster", ["light"])


@query("a21_spans", "frames", "SELECT track, event_type, min(frame) AS first_frame, max(frame) AS last_frame FROM frames GROUP BY 1, 2")
def a21(frames):
    return A.spans(frames, ["track", "event_type"])


@query("a22_crop_box", "frames", "SELECT track, greatest(0, CAST(round_even(min(x) - 15, 0) AS INT)) AS x_min, least(100, CAST(round_even(max(x) + 15, 0) AS INT)) AS x_max, greatest(0, CAST(round_even(min(y) - 15, 0) AS INT)) AS y_min, least(110, CAST(round_even(max(y) + 15, 0) AS INT)) AS y_max FROM frames GROUP BY 1")
def a22(frames):
    return A.crop_box(frames, ["track"], ["x"], ["y"], 100, 110)


@query("a25_inactive", "frames", "SELECT recording, track, max(abs(y - y0)) <= 45 AS inactive FROM (SELECT *, first_value(y IGNORE NULLS) OVER (PARTITION BY recording, track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y0 FROM frames WHERE frame > 10) GROUP BY 1, 2")
def a25(frames):
    return A.inactive(frames, ["recording", "track"], 10, 45.0)


@query("a26_constant_metadata", "frames", "SELECT track, concat_ws(' | ', CASE WHEN count(DISTINCT grp) = 1 THEN concat('grp: ', max(grp)) END, CASE WHEN count(DISTINCT event_type) = 1 THEN concat('event_type: ', max(event_type)) END, CASE WHEN count(DISTINCT recording) = 1 THEN concat('recording: ', CAST(max(recording) AS STRING)) END) AS metadata FROM frames GROUP BY 1")
def a26(frames):
    return A.constant_metadata(frames, "track", ["grp", "event_type", "recording"])


@query("a27_histogram", "ev", "SELECT event_type, CAST(least(floor((v - lo) / (hi - lo) * bins), bins - 1) AS INT) AS bin, count(*) AS count FROM (SELECT event_type, displacement AS v FROM ev WHERE displacement IS NOT NULL) JOIN (SELECT event_type, min(displacement) AS lo, max(displacement) AS hi, greatest(1, ceil((max(displacement) - min(displacement)) / (2 * (quantile_cont(displacement, 0.75) - quantile_cont(displacement, 0.25)) / cbrt(count(displacement))))) AS bins FROM ev GROUP BY 1) USING (event_type) GROUP BY 1, 2")
def a27(ev):
    return A.histogram(ev, "event_type", "displacement")


JOINT = '(SELECT CAST(least(floor((x - x0) / (x1 - x0) * 50), 49) AS INT) AS "bx", CAST(least(floor((y - y0) / (y1 - y0) * 20), 19) AS INT) AS "by" FROM frames, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM frames) WHERE x IS NOT NULL AND y IS NOT NULL)'


@query("a28_joint_counts", "frames", f'SELECT bx, "by", count(*) AS count FROM {JOINT} GROUP BY GROUPING SETS ((bx, "by"), (bx), ("by"))')
def a28(frames):
    return A.joint_counts(frames, "x", "y", (50, 20))


@query("a29_box_stats", "ev", "SELECT e.event_type, q1, median, q3, q95, min, max, min(displacement) AS low, max(displacement) AS high FROM ev e JOIN (SELECT event_type, quantile_cont(displacement, 0.25) AS q1, quantile_cont(displacement, 0.5) AS median, quantile_cont(displacement, 0.75) AS q3, quantile_cont(displacement, 0.95) AS q95, min(displacement) AS min, max(displacement) AS max FROM ev GROUP BY 1) q ON e.event_type = q.event_type AND displacement BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL", "q1 median q3 q95 min max low high")
def a29(ev):
    return A.box_stats(ev, "event_type", "displacement")


@query("a30_control_band", "frames", "SELECT quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM frames WHERE is_control", "lo hi")
def a30(frames):
    return A.control_band(frames, "x", "is_control")


@query("a31_file_audit", "paths", f"SELECT folder, count(*) AS n, count(*) FILTER (path LIKE '%?%') AS n_processed, CASE WHEN count(*) > count(*) FILTER (path LIKE '%?%') THEN count(*) FILTER (path LIKE '%?%') / (count(*) - count(*) FILTER (path LIKE '%?%')) ELSE 0 END AS ratio, count(*) FILTER (path LIKE '%.html') > 1 AS several, sum(size)::BIGINT AS size FROM {PATHS} GROUP BY 1", "ratio")
def a31(paths):
    return A.file_audit(files(paths), "folder", F.contains("path", F.lit("?")), F.col("path").rlike(r"\.html$"))


@query("a32_compared", "ev", "SELECT event_type, n, seconds, n / base * 100 AS percent, 100 - n / base * 100 AS savings, n = min(n) OVER () AS best_size, seconds = min(seconds) OVER () AS best_time FROM (SELECT event_type, count(*) AS n, sum(displacement) AS seconds FROM ev GROUP BY 1), (SELECT count(*) AS base FROM ev WHERE event_type = 'view')", "seconds percent savings")
def a32(ev):
    sizes = ev.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("displacement").alias("seconds"))
    return A.compared(sizes, "event_type", "view", "n", "seconds")


CIRCLE = "SELECT recording, track, r FROM (SELECT recording, track, frame, sqrt((ax - ux) ** 2 + (ay - uy) ** 2) AS r FROM (SELECT *, (a2 * (yb - cy) + b2 * (cy - ay) + c2 * (ay - yb)) / nullif(d, 0) AS ux, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / nullif(d, 0) AS uy FROM (SELECT *, ax * ax + ay * ay AS a2, bx * bx + yb * yb AS b2, cx * cx + cy * cy AS c2, 2 * (ax * (yb - cy) + bx * (cy - ay) + cx * (ay - yb)) AS d FROM (SELECT recording, track, frame, x AS ax, y AS ay, lead(x, 1) OVER w AS bx, lead(y, 1) OVER w AS yb, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy FROM frames WHERE x IS NOT NULL WINDOW w AS (PARTITION BY recording, track ORDER BY frame)))))"


def circles(frames):
    from pyspark.sql import Window

    w = Window.partitionBy("recording", "track").orderBy("frame")
    nxt = lambda c, k: F.lead(c, k).over(w)
    seen = frames.where("x IS NOT NULL")
    three = seen.select("recording", "track", "frame", F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x", 1).alias("bx"), nxt("y", 1).alias("by"), nxt("x", 2).alias("cx"), nxt("y", 2).alias("cy"))
    return three.select("recording", "track", "frame", S.circle("ax", "ay", "bx", "by", "cx", "cy").alias("c"))


@query("a33_radius", "frames", f"SELECT recording, track, round(avg(CASE WHEN r < 1e4 THEN r END), 4) AS mean_r, round(median(CASE WHEN r < 1e4 THEN r END), 4) AS median_r FROM ({CIRCLE}) GROUP BY 1, 2")
def a33(frames):
    r = F.when(F.col("c.r") < 1e4, F.col("c.r"))
    return circles(frames).groupBy("recording", "track").agg(F.round(F.avg(r), 4).alias("mean_r"), F.round(F.percentile(r, F.lit(0.5)), 4).alias("median_r"))


@query("a34_sampled_audit", "frames", "SELECT recording, bool_or(n >= 2) AS flagged FROM (SELECT recording, frame, count(*) AS n, row_number() OVER (PARTITION BY recording ORDER BY md5(concat('7|', recording, '|', frame)), frame) AS r FROM frames WHERE x > 50 GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1")
def a34(frames):
    n = frames.where("x > 50").groupBy("recording", "frame").agg(F.count("*").alias("n"))
    return R.sampled(n, ["recording"], F.concat_ws("|", "recording", "frame"), 3, seed=7, ties=["frame"]).groupBy("recording").agg(F.bool_or(F.col("n") >= 2).alias("flagged"))


@query("o1_order_by_median", "ev", "SELECT event_type, cluster, dense_rank() OVER (ORDER BY gm, event_type) AS group_rank, row_number() OVER (PARTITION BY event_type ORDER BY m, cluster) AS sub_rank FROM (SELECT *, median(m) OVER (PARTITION BY event_type) AS gm FROM (SELECT event_type, cluster, median(displacement) AS m FROM ev GROUP BY 1, 2))")
def o1(ev):
    return R.by_median(ev, "event_type", "cluster", "displacement")


@query("o2_explicit_order", "ev", "SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 END AS sort_rank FROM ev")
def o2(ev):
    return R.explicit(ev, "event_type", ["view", "click"]).select("event_id", "sort_rank")


@query("o3_group_order", "units", "SELECT grp, row_number() OVER (ORDER BY CASE WHEN grp LIKE 'PG%' THEN 0 WHEN grp IN ('B6VF', 'B6XOGL7') THEN 2 ELSE 1 END, CAST(coalesce(nullif(regexp_extract(grp, '[0-9]+', 0), ''), '0') AS INT), grp) AS sort_rank FROM (SELECT DISTINCT grp FROM units)")
def o3(units):
    return R.group_order(units.select("grp").distinct(), "grp")


@query("o4_natural_order", "paths", "SELECT page_id, CAST(coalesce(nullif(regexp_extract(path, '[0-9]+', 0), ''), '0') AS INT) AS number FROM paths")
def o4(paths):
    return paths.select("page_id", S.first_number("path").alias("number"))


@query("o5_top_events", "ev", "SELECT cluster, event_id, displacement FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY displacement DESC NULLS LAST, event_id) AS r FROM ev) WHERE r <= 5", "displacement")
def o5(ev):
    return R.top(ev, ["cluster"], "displacement", 5, ["event_id"]).select("cluster", "event_id", "displacement")


@query("o6_seeded_sample", "ev", "SELECT cluster, event_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(concat('42|', event_id)), event_id) AS r FROM ev) WHERE r <= 10")
def o6(ev):
    return R.sampled(ev, ["cluster"], F.col("event_id").cast("string"), 10, seed=42, ties=["event_id"]).select("cluster", "event_id")


@query("o8_stratified_sample", "ev", "SELECT cluster, event_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(concat('42|', event_id)), event_id) AS r, count(*) OVER (PARTITION BY cluster) AS n, (SELECT count(*) FROM ev) AS total FROM ev) WHERE r <= round_even(500.0 * n / total, 0)")
def o8(ev):
    return R.stratified(ev, "cluster", F.col("event_id").cast("string"), 500, seed=42, ties=["event_id"]).select("cluster", "event_id")


@query("o9_first_paths", "paths", f"SELECT folder, page_id FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path LIKE '%?%', path, page_id) AS r FROM {PATHS}) WHERE r <= 18")
def o9(paths):
    return R.first_files(files(paths), "folder", F.contains("path", F.lit("?")), ["path", "page_id"], 18).select("folder", "page_id")


@query("u1_union_tables", "points", "SELECT recording, track, frame, node, x FROM points UNION ALL SELECT recording, track, frame, 'centre', avg(x) FROM points GROUP BY 1, 2, 3", "x")
def u1(points):
    centre = points.groupBy("recording", "track", "frame").agg(F.avg("x").alias("x")).withColumn("node", F.lit("centre"))
    return points.unionByName(centre, allowMissingColumns=True).select("recording", "track", "frame", "node", "x")


@query("u2_distinct", "frames", "SELECT DISTINCT recording, grp FROM frames")
def u2(frames):
    return frames.select("recording", "grp").distinct()


@query("u3_set_difference", "paths", f"SELECT name, 'local' AS side FROM (SELECT name FROM {PATHS} WHERE size < 3000 EXCEPT SELECT name FROM {PATHS} WHERE size >= 3000) UNION ALL SELECT name, 'both' FROM (SELECT name FROM {PATHS} WHERE size < 3000 INTERSECT SELECT name FROM {PATHS} WHERE size >= 3000)")
def u3(paths):
    f = files(paths)
    a, b = f.where("size < 3000").select("name"), f.where("size >= 3000").select("name")
    return a.subtract(b).withColumn("side", F.lit("local")).union(a.intersect(b).withColumn("side", F.lit("both")))


@query("u4_collisions", "paths", f"SELECT page_id, name, row_number() OVER (PARTITION BY name ORDER BY path, page_id) AS rank FROM {PATHS}")
def u4(paths):
    return N.collisions(files(paths).withColumn("o", F.struct("path", "page_id")), "name", "o").select("page_id", "name", "rank")


@query("u5_key_product", "ev", "SELECT cluster, light FROM (SELECT DISTINCT cluster FROM ev) CROSS JOIN (SELECT DISTINCT light FROM ev)")
def u5(ev):
    return R.key_product(ev, ["cluster", "light"])

"""A23, A24, W14-W16, X3."""

from pyspark.sql import functions as F

from posekit.operators import tracks as O
from posekit.plans.registry import query

STATS = """(SELECT s.*, round(coalesce(n_present / nullif(n_frames, 0), 0), 9) AS occupancy FROM (
  SELECT recording, track, count(*) FILTER (present) AS n_present, round(CASE WHEN count(*) FILTER (present) = 0 THEN 0.0 ELSE coalesce(avg(CASE WHEN present THEN score END), 1.0) END, 9) AS mean_score
  FROM (SELECT recording, track, frame, bool_or(x IS NOT NULL OR y IS NOT NULL) AS present, avg(score) AS score FROM points GROUP BY 1, 2, 3) GROUP BY 1, 2) s
  JOIN (SELECT recording, max(frame) AS n_frames FROM points GROUP BY 1) USING (recording))"""
CENTROIDS = "(SELECT recording, track, frame, avg(x) AS cx, avg(y) AS cy FROM points GROUP BY 1, 2, 3 HAVING avg(x) IS NOT NULL)"
KEPT = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY mean_score DESC, occupancy DESC, track) AS rank FROM {STATS} WHERE occupancy >= 0.3 AND mean_score >= 0.5))"
PAIRS = f"""(SELECT recording, a, b, ra, rb, n_near, round(n_near / greatest(n_a, 1), 9) AS share FROM (
  SELECT a.recording, a.track AS a, b.track AS b, a.rank AS ra, b.rank AS rb, count(*) FILTER (round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 9) < 50) AS n_near
  FROM (SELECT c.*, rank FROM {CENTROIDS} c JOIN {KEPT} k USING (recording, track) WHERE rank <= 4) a JOIN (SELECT c.*, rank FROM {CENTROIDS} c JOIN {KEPT} k USING (recording, track) WHERE rank <= 4) b
  ON a.recording = b.recording AND a.frame = b.frame AND a.rank > b.rank GROUP BY ALL)
  JOIN (SELECT recording, track AS a, count(*) AS n_a FROM {CENTROIDS} GROUP BY 1, 2) USING (recording, a))"""


def every(points):
    """All tracks, and the frames of each recording. At most four tracks of a recording are ever paired."""
    return points, points.groupBy("recording").agg(F.max("frame").alias("n_frames"))


@query("a23_track_stats", "points", f"SELECT recording, track, n_present, mean_score, occupancy FROM {STATS}", "mean_score occupancy")
def a23(points):
    return O.track_stats(*every(points)).select("recording", "track", "n_present", "mean_score", "occupancy")


@query("a24_overlaps", "points", f"SELECT recording, a, b, n_near, share FROM {PAIRS} WHERE share >= 0.35", "share")
def a24(points):
    p, n = every(points)
    kept = O.ranked(O.track_stats(p, n), 0.3, 0.5).where("rank <= 4")
    return O.overlaps(kept, O.centroids(p), 50.0, 0.35).select("recording", "a", "b", "n_near", "share")


@query("x3_centroids", "points", f"SELECT recording, track, frame, cx, cy FROM {CENTROIDS}", "cx cy")
def x3(points):
    return O.centroids(points)


# Survivors of at most four ranks, written out: a rank goes if it overlaps a surviving better one.
ALIVE = f"""(SELECT recording, a1, a2, a3, (r4 AND NOT (a1 AND o41 OR a2 AND o42 OR a3 AND o43)) AS a4, o21, o31, o32, o41, o42, o43 FROM (
  SELECT *, (r3 AND NOT (a1 AND o31 OR a2 AND o32)) AS a3 FROM (SELECT *, (r2 AND NOT (a1 AND o21)) AS a2 FROM (
    SELECT k.recording, true AS a1, max(rank) >= 2 AS r2, max(rank) >= 3 AS r3, max(rank) >= 4 AS r4, """ + ", ".join(f"coalesce(bool_or(p.ra = {i} AND p.rb = {j}), false) AS o{i}{j}" for i in (2, 3, 4) for j in range(1, i)) + f"""
    FROM {KEPT} k LEFT JOIN (SELECT * FROM {PAIRS} WHERE share >= 0.35) p ON k.recording = p.recording WHERE rank <= 4 GROUP BY 1))))"""
SELECTED = f"""SELECT s.recording, s.track, s.n_present, coalesce(CASE k.rank WHEN 1 THEN a1 WHEN 2 THEN a2 WHEN 3 THEN a3 WHEN 4 THEN a4 END, false) AS kept,
  CASE WHEN CASE k.rank WHEN 1 THEN a1 WHEN 2 THEN a2 WHEN 3 THEN a3 WHEN 4 THEN a4 END THEN 'present + confident'
    WHEN k.rank <= 4 THEN concat('overlaps higher-score track ''', b.track, '''')
    WHEN s.occupancy < 0.3 AND s.mean_score < 0.5 THEN 'short + low-score parasite' WHEN s.occupancy < 0.3 THEN 'occupancy < 30%' WHEN s.mean_score < 0.5 THEN 'score < 0.5' ELSE 'exceeds max_tracks=4' END AS reason
  FROM {STATS} s LEFT JOIN {KEPT} k USING (recording, track) LEFT JOIN {ALIVE} l USING (recording)
  LEFT JOIN {KEPT} b ON b.recording = s.recording AND b.rank = CASE k.rank WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN a1 AND o31 THEN 1 ELSE 2 END WHEN 4 THEN CASE WHEN a1 AND o41 THEN 1 WHEN a2 AND o42 THEN 2 ELSE 3 END END AND k.rank <= 4"""


@query("w16_select_tracks", "points", SELECTED)
def w16(points):
    return O.select_tracks(*every(points), least_score=0.5, least_occupancy=0.3, most=4, overlap_distance=50.0, overlap_fraction=0.35).select("recording", "track", "n_present", "kept", "reason")


INSTANCES = "(SELECT recording, frame, track AS instance, x, score FROM points WHERE node = 'thorax' AND x IS NOT NULL)"
BEST = f"(SELECT *, row_number() OVER (PARTITION BY recording, frame ORDER BY score DESC, instance) AS r, first_value(x) OVER (PARTITION BY recording, frame ORDER BY score DESC, instance) AS x1 FROM {INSTANCES})"


def instances(points):
    return points.where("node = 'thorax' AND x IS NOT NULL").select("recording", "frame", F.col("track").alias("instance"), "x", "score")


@query("w14_two_best", "points", f"SELECT recording, frame, instance, concat('track_', row_number() OVER (PARTITION BY recording, frame ORDER BY x, instance)) AS name FROM (SELECT *, min(CASE WHEN r > 1 AND abs(x - x1) > 40 THEN r END) OVER (PARTITION BY recording, frame) AS second FROM {BEST}) WHERE r = 1 OR r = second")
def w14(points):
    return O.two_best(instances(points), ["recording", "frame"], 40.0).select("recording", "frame", "instance", "name")


@query("w15_named_by_x", "points", f"SELECT recording, frame, instance, concat('track_', row_number() OVER (PARTITION BY recording, frame ORDER BY x, instance)) AS name FROM {INSTANCES}")
def w15(points):
    return O.named_by_x(instances(points), ["recording", "frame"]).select("recording", "frame", "instance", "name")

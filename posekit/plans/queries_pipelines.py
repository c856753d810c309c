"""P1-P9."""

from pyspark.sql import functions as F

from posekit.plans import jobs as J
from posekit.plans.queries_filters import embedded
from posekit.plans.queries_learn import ASSIGNED_SQL, by_model
from posekit.plans.queries_joins import PATHS, files, name_map
from posekit.plans.queries_names import folders  # noqa: F401
from posekit.plans.queries_stats import BINNED, REPS, _bh, _boot, _draw, _perm  # noqa: F401
from posekit.plans.queries_tracks import SELECTED, every
from posekit.plans.queries_windows import OVER, SG_SPEED, SMOOTHED
from posekit.plans.registry import query
from posekit.sources import io

NODES = ["head", "thorax", "abdomen"]
#: Every node's x and y as a series of its own, smoothed in SQL as W4 is; then one row a frame.
LIMBS = "(SELECT recording, track || '|' || node || '|' || a AS track, '' AS grp, frame, 0.0 AS time, CASE a WHEN 'x' THEN x ELSE y END AS x FROM bodies CROSS JOIN (SELECT unnest(['x', 'y']) AS a))"
WIDE = "(SELECT recording, CAST(split_part(track, '|', 1) AS BIGINT) AS track, frame, " + ", ".join(f"max(CASE WHEN track LIKE '%|{n}|{c}' THEN s END) AS {c}_{n}" for n in NODES for c in "xy") + f" FROM ({SMOOTHED.replace('FROM frames', 'FROM ' + LIMBS)}) GROUP BY 1, 2, 3)"
SLOPE = "FPS * CASE WHEN rn = 1 AND rn = n THEN NULL WHEN rn = 1 THEN lead({c}) OVER w - {c} WHEN rn = n THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END"
AXIS = f"""(SELECT *, row_number() OVER ({OVER}) AS rn, count(*) OVER (PARTITION BY recording, track) AS n, (x_head - x_abdomen) / nullif(sqrt((x_head - x_abdomen) ** 2 + (y_head - y_abdomen) ** 2), 0) AS ux,
  (y_head - y_abdomen) / nullif(sqrt((x_head - x_abdomen) ** 2 + (y_head - y_abdomen) ** 2), 0) AS uy FROM {WIDE} JOIN (SELECT recording, track, frame, x IS NOT NULL AS seen FROM bodies WHERE node = 'thorax') USING (recording, track, frame))"""
TURNS = f"(SELECT *, h - lag(h) OVER (PARTITION BY recording, track, h IS NULL ORDER BY frame) AS step FROM (SELECT *, CASE WHEN ux IS NOT NULL THEN atan2(uy, ux) END AS h FROM {AXIS}))"
UNWRAPPED = f"(SELECT *, CASE WHEN h IS NOT NULL THEN h - 2 * pi() * sum(CASE WHEN step > pi() THEN 1 WHEN step < -pi() THEN -1 ELSE 0 END) OVER (PARTITION BY recording, track, h IS NULL ORDER BY frame) END AS hu FROM {TURNS})"
SLOPES = f"(SELECT *, {SLOPE.format(c='x_thorax')} AS vx, {SLOPE.format(c='y_thorax')} AS vy, {SLOPE.format(c='hu')} AS vh FROM {UNWRAPPED} WINDOW w AS ({OVER}))"
KINEMATICS = f"""SELECT recording, track, frame, CASE WHEN seen THEN x_thorax / 26 END AS centroid_x, CASE WHEN seen THEN y_thorax / 26 END AS centroid_y, CASE WHEN seen THEN degrees(h) END AS heading_deg,
  CASE WHEN seen THEN sqrt(vx ** 2 + vy ** 2) / 26 END AS speed, CASE WHEN seen THEN (vx * ux + vy * uy) / 26 END AS forward_velocity,
  CASE WHEN seen AND vx * ux + vy * uy IS NOT NULL THEN greatest(-(vx * ux + vy * uy) / 26, 0) END AS backward_speed, CASE WHEN seen THEN (-vx * uy + vy * ux) / 26 END AS lateral_velocity,
  CASE WHEN seen THEN degrees(vh) END AS rotational_velocity FROM {SLOPES}"""
KINEMATICS, SLOW_KINEMATICS = KINEMATICS.replace("FPS", "80"), KINEMATICS.replace("FPS", "0.1")
SPEED = f"""SELECT k.*, grp, is_control FROM (SELECT recording, track, count(f) AS n_frames, avg(speed) AS mean_speed, avg(f) AS mean_forward_velocity, avg(CASE WHEN f > 0 THEN f END) AS mean_forward_speed,
  avg(CASE WHEN f < 0 THEN f END) AS mean_backward_speed, avg(CASE WHEN f < 0 THEN -f WHEN f >= 0 THEN 0 END) AS mean_backward_speed_rect, count(CASE WHEN f > 0 THEN 1 END) / greatest(count(f), 1) AS frac_forward,
  count(CASE WHEN f < 0 THEN 1 END) / greatest(count(f), 1) AS frac_backward, avg(abs(rotational_velocity)) AS mean_abs_rotational
  FROM (SELECT *, forward_velocity AS f FROM ({KINEMATICS})) GROUP BY 1, 2) k LEFT JOIN (SELECT DISTINCT recording, track, grp, is_control FROM frames) USING (recording, track)"""
MOTION = ["centroid_x", "centroid_y", "heading_deg", "speed", "forward_velocity", "backward_speed", "lateral_velocity", "rotational_velocity"]
FLY = "mean_speed mean_forward_velocity mean_forward_speed mean_backward_speed mean_backward_speed_rect frac_forward frac_backward mean_abs_rotational"


@query("p1_clean_tracks", "points", f"SELECT recording, track, kept, reason, NOT bool_or(kept) OVER (PARTITION BY recording) AS empty_recording, n AS n_points FROM ({SELECTED}) LEFT JOIN (SELECT recording, track, count(*) AS n FROM points GROUP BY 1, 2) USING (recording, track)")
def p1(points):
    p, n = every(points)
    kept, report = J.clean_tracks(p, n, least_score=0.5, least_occupancy=0.3, most=4, overlap_distance=50.0, overlap_fraction=0.35)
    size = p.groupBy("recording", "track").agg(F.count("*").alias("n_points"))
    return report.join(size, ["recording", "track"], "left").select("recording", "track", "kept", "reason", "empty_recording", "n_points")


@query("p1_kept_points", "points", f"SELECT recording, track, frame, node FROM points WHERE (recording, track) IN (SELECT (recording, track) FROM ({SELECTED}) WHERE kept)")
def p1b(points):
    p, n = every(points)
    kept, _ = J.clean_tracks(p, n, least_score=0.5, least_occupancy=0.3, most=4, overlap_distance=50.0, overlap_fraction=0.35)
    return kept.select("recording", "track", "frame", "node")


@query("p2_per_fly_speed", "bodies frames", SPEED, FLY, digits=6)
def p2(bodies, frames):
    labels = frames.select("recording", "track", "grp", "is_control").distinct()
    return J.per_fly_speed(bodies, labels, NODES, 80.0, 11, 1, ["thorax"], 26.0)


@query("p2_track_kinematics", "bodies", KINEMATICS, " ".join(MOTION), digits=6)
def p2b(bodies):
    return J.track_kinematics(bodies, NODES, 80.0, 11, 1, ["thorax"], 26.0).select("recording", "track", "frame", *MOTION)


#: A collection at one frame in ten seconds, so that tracks reach over many pulses.
LABELLED = f"""(SELECT k.recording, k.track, k.speed, k.forward_velocity, k.backward_speed, k.rotational_velocity, grp, is_control, sequence, k.time, 10.0 AS dt, p.on_index, p.on_index IS NOT NULL AS stim_on
  FROM (SELECT *, frame / 0.1 AS time FROM ({SLOW_KINEMATICS})) k
  JOIN (SELECT recording, CASE WHEN geno = 'B6VF_1min' THEN 'B6VF' ELSE 'PG' || regexp_extract(geno, '[0-9]+') END AS grp, geno = 'B6VF_1min' AS is_control, CASE folder WHEN 'PG' THEN 'short' WHEN 'PG_20240131' THEN 'long' END AS sequence
    FROM (SELECT recording, split_part(path, '/', 3) AS folder, split_part(path, '/', 4) AS geno FROM videos) WHERE geno NOT LIKE '%bad%') v USING (recording)
  LEFT JOIN pulses p ON p.seq = v.sequence AND k.time >= p.start_s AND k.time < p.end_s
  WHERE recording IN (SELECT recording FROM bodies GROUP BY 1 HAVING count(DISTINCT track) <= 40))"""
#: The same in its scopes, computed once a query.
IN_SCOPES = f"WITH labelled AS MATERIALIZED (SELECT * FROM {LABELLED}), scoped AS MATERIALIZED (SELECT *, recording || '/' || track AS fly FROM (SELECT 'shared' AS scope, * FROM labelled WHERE time <= 360.5 UNION ALL SELECT 'long', * FROM labelled WHERE sequence = 'long'))"
OWN = "scope, recording, grp, is_control, track"
P3_FLY = f"""SELECT {OWN}, count(f) AS n_frames, avg(speed) AS mean_speed, avg(f) AS mean_forward_velocity, avg(CASE WHEN f > 0 THEN f END) AS mean_forward_speed, avg(CASE WHEN f < 0 THEN f END) AS mean_backward_speed,
  avg(backward_speed) AS mean_backward_speed_rect, count(CASE WHEN f > 0 THEN 1 END) / greatest(count(f), 1) AS frac_forward, count(CASE WHEN f < 0 THEN 1 END) / greatest(count(f), 1) AS frac_backward,
  avg(abs(rotational_velocity)) AS mean_abs_rotational FROM (SELECT *, forward_velocity AS f FROM scoped) GROUP BY {OWN}"""
P3_ON_OFF = f"SELECT {OWN}, " + ", ".join(f"avg(CASE WHEN {'' if s == 'on' else 'NOT '}stim_on THEN {c} END) AS {k}_{s}" for k, c in (("speed", "speed"), ("forward", "forward_velocity")) for s in ("on", "off")) + f" FROM scoped GROUP BY {OWN}"
AVERAGES = ", ".join(f"avg({c}) AS {c}" for c in J.METRICS)
AROUND = f"(SELECT k.*, p.on_index AS pulse, floor((k.time - p.start_s) / 5.0) * 5.0 AS rb FROM scoped k JOIN pulses p ON p.seq = CASE k.scope WHEN 'shared' THEN 'short' ELSE 'long' END AND k.time >= p.start_s - 10 AND k.time < p.start_s + 70 WHERE speed IS NOT NULL)"
P3_STIM = f"SELECT {OWN}, on_index, sum(greatest(-forward_velocity, 0) * dt) AS back_dist, sum(greatest(forward_velocity, 0) * dt) AS fwd_dist, sum(forward_velocity * dt) AS net_forward FROM scoped WHERE stim_on AND forward_velocity IS NOT NULL GROUP BY {OWN}, on_index"


def _stacked(sql: str, columns: dict[str, str], more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT scope, grp, is_control, recording || '/' || track AS track, '{k}' AS metric, {c} AS v{more} FROM ({sql})" for k, c in columns.items())


def _armed(sql: str) -> str:
    """Arms against the pooled control, as (keys, test, arm, v)."""
    return f"(SELECT s.*, t.test, CASE WHEN is_control THEN 'b' ELSE 'a' END AS arm FROM ({sql}) s JOIN (SELECT DISTINCT grp AS test FROM ({sql}) WHERE NOT is_control) t ON s.is_control OR s.grp = t.test)"


def _bh_over(sql: str, over: str) -> str:
    q = f"SELECT *, p * count(p) OVER (PARTITION BY {over}) / row_number() OVER (PARTITION BY {over}, p IS NULL ORDER BY p) AS q FROM ({sql})"
    adj = f"SELECT * EXCLUDE (q), CASE WHEN p IS NOT NULL THEN least(min(q) OVER (PARTITION BY {over}, p IS NULL ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) END AS p_adj FROM ({q})"
    return f"SELECT *, CASE WHEN p_adj IS NULL THEN '' WHEN p_adj < 0.001 THEN '***' WHEN p_adj < 0.01 THEN '**' WHEN p_adj < 0.05 THEN '*' ELSE 'ns' END AS stars FROM ({adj})"


def _tested(sql: str, keys: str, least: str = "") -> str:
    """A test of every line against the pooled control, adjusted within scope and metric."""
    tests = _perm(f"scope, metric, test{keys}", "arms", "v")
    return f"{IN_SCOPES}, units AS MATERIALIZED ({sql}), arms AS MATERIALIZED (SELECT * FROM {_armed('SELECT * FROM units')}), tests AS MATERIALIZED (SELECT * FROM ({tests}){least}) " + _bh_over("SELECT * FROM tests", "scope, metric")


P3_SUMMARY = _tested(_stacked(P3_FLY, J.METRICS), "")
P3_PULSES = _tested(_stacked(P3_STIM, {"back_dist": "back_dist", "net_forward": "net_forward"}, ", on_index"), ", on_index", " WHERE n_a >= 3 AND n_b >= 3")
P3_PAIRED = f"{IN_SCOPES}, pairs AS MATERIALIZED (SELECT * FROM (" + " UNION ALL ".join(f"SELECT scope, '{k}' AS metric, grp, recording || '/' || track AS track, {k}_on - {k}_off AS d FROM ({P3_ON_OFF})" for k in ("speed", "forward")) + ") WHERE d IS NOT NULL) " + _bh_over(f"""SELECT s.*, p FROM (SELECT scope, metric, grp, count(d) AS n_pairs, avg(d) AS diff FROM pairs GROUP BY 1, 2, 3) s LEFT JOIN (
  SELECT scope, metric, grp, (count(CASE WHEN round(abs(f), 9) >= round(abs(diff), 9) THEN 1 END) + 1) / ({REPS} + 1) AS p FROM (
    SELECT scope, metric, grp, rep, avg((1 - 2 * (({_draw('scope', 'metric', 'grp', 'CAST(rep AS VARCHAR)', 'track')}) % 2)) * d) AS f FROM pairs CROSS JOIN (SELECT unnest(range(1, {REPS + 1})) AS rep) GROUP BY 1, 2, 3, 4)
  JOIN (SELECT scope, metric, grp, avg(d) AS diff FROM pairs GROUP BY 1, 2, 3) USING (scope, metric, grp) GROUP BY 1, 2, 3) USING (scope, metric, grp)""", "scope, metric")


def velocity(bodies, videos, pulses, table):
    lab = io.written(J.labelled_kinematics(bodies, videos, pulses, NODES, 0.1, 11, 1, ["thorax"], 26.0, ["BAD"], 40), "frames")
    return J.directional_velocity(lab, pulses, REPS, bin_s=5.0, tables=[table])[table]


@query("p3_directional_velocity", "bodies videos pulses", P3_PULSES, "diff p p_adj", digits=6)
def p3(bodies, videos, pulses):
    """The job's last table: each line against the pooled control, by scope, distance and pulse."""
    return velocity(bodies, videos, pulses, "per_stim_tests")


@query("p3_per_fly", "bodies videos pulses", f"{IN_SCOPES} {P3_FLY}", FLY, digits=6)
def p3_fly(bodies, videos, pulses):
    return velocity(bodies, videos, pulses, "per_fly")


@query("p3_on_off", "bodies videos pulses", f"{IN_SCOPES} {P3_ON_OFF}", "speed_on speed_off forward_on forward_off", digits=6)
def p3_on_off(bodies, videos, pulses):
    return velocity(bodies, videos, pulses, "on_off")


@query("p3_psth", "bodies videos pulses", f"{IN_SCOPES} SELECT {OWN}, rb, {AVERAGES} FROM {AROUND} GROUP BY {OWN}, rb", "rb " + " ".join(J.METRICS), digits=6)
def p3_psth(bodies, videos, pulses):
    return velocity(bodies, videos, pulses, "psth")


@query("p3_psth_per_pulse", "bodies videos pulses", f"{IN_SCOPES} SELECT scope, grp, pulse AS on_index, rb, {AVERAGES} FROM (SELECT {OWN}, pulse, rb, {AVERAGES} FROM {AROUND} GROUP BY {OWN}, pulse, rb) GROUP BY 1, 2, 3, 4", "rb " + " ".join(J.METRICS), digits=6)
def p3_psth_pulse(bodies, videos, pulses):
    return velocity(bodies, videos, pulses, "psth_per_pulse")


@query("p3_per_pulse", "bodies videos pulses", f"{IN_SCOPES} SELECT {OWN}, on_index, {AVERAGES} FROM scoped WHERE stim_on GROUP BY {OWN}, on_index", " ".join(J.METRICS), digits=6)
def p3_pulse(bodies, videos, pulses):
    return velocity(bodies, videos, pulses, "per_pulse")


@query("p3_per_stim", "bodies videos pulses", f"{IN_SCOPES} {P3_STIM}", "back_dist fwd_dist net_forward", digits=6)
def p3_stim(bodies, videos, pulses):
    return velocity(bodies, videos, pulses, "per_stim")


@query("p3_summary_tests", "bodies videos pulses", P3_SUMMARY, "diff p p_adj", digits=6)
def p3_summary(bodies, videos, pulses):
    return velocity(bodies, videos, pulses, "summary_tests")


@query("p3_on_off_tests", "bodies videos pulses", P3_PAIRED, "diff p p_adj", digits=6)
def p3_pairs(bodies, videos, pulses):
    return velocity(bodies, videos, pulses, "on_off_tests")


@query("p4_binned_group_test", "frames", f"SELECT *, p_adj < 0.05 AS significant FROM ({_bh('SELECT time_bin, CASE WHEN p IS NULL THEN 0 ELSE diff END AS diff, coalesce(p, 1.0) AS p FROM (' + _perm('time_bin', '(SELECT CAST(greatest(ceil((time - mn) / (mx - mn) * 8) - 1, 0) AS INT) AS time_bin, track, CASE WHEN grp = ' + chr(39) + 'B6VF' + chr(39) + ' THEN ' + chr(39) + 'b' + chr(39) + ' ELSE ' + chr(39) + 'a' + chr(39) + ' END AS arm, avg(x) AS v FROM frames, (SELECT min(time) AS mn, max(time) AS mx FROM frames) GROUP BY 1, 2, 3)', 'v', 0) + ')')})", "diff p p_adj")
def p4(frames):
    return J.binned_group_test(frames, "time", "x", "grp", "track", "B6VF", 8, REPS)


@query("p5_behaviour_map", "embeddings")
def p5(emb):
    wide = embedded(emb)
    cols = [f"{a}_{n}_fly" for n in range(6) for a in "xy"]
    return J.behaviour_map(wide.select("vec_id", "label", *cols), cols, 12, "label")


#: Events with a cluster by a given model, a fly, a time bin, a kind and a displacement, all of the embeddings' rows.
EVENTS = f"(SELECT cluster, a.label % 2 AS kind, a.vec_id % 17 AS track, a.vec_id % 5 AS bin, CAST(embedding[9] AS DOUBLE) * 100 AS displacement FROM {ASSIGNED_SQL} a JOIN embeddings e ON a.vec_id = e.vec_id)"
P5_COUNTS = f"(SELECT kind, track, bin, cluster, count(*) AS count FROM {EVENTS} GROUP BY ALL)"
P5_SUBJECTS = f"(SELECT *, count / sum(count) OVER (PARTITION BY kind, track, bin) AS share FROM (SELECT kind, track, bin, cluster, coalesce(count, 0) AS count FROM (SELECT DISTINCT kind, track, bin FROM {EVENTS}) CROSS JOIN (SELECT DISTINCT cluster FROM {EVENTS}) LEFT JOIN {P5_COUNTS} USING (kind, track, bin, cluster)))"
P5_RANKS = f"(SELECT cluster, median, row_number() OVER (ORDER BY median DESC, cluster) AS rank FROM (SELECT cluster, median(displacement) AS median FROM {EVENTS} WHERE displacement > 0 GROUP BY 1))"
P5_WEIGHTED = f"(SELECT kind, track, bin, sum(count * coalesce(median, 0)) / sum(count) AS weighted FROM {P5_COUNTS} LEFT JOIN {P5_RANKS} USING (cluster) GROUP BY 1, 2, 3)"


def _interval(keys: str, src: str, value: str) -> str:
    return f"SELECT {keys}, n, point, lo, hi FROM (SELECT {keys}, count({value}) AS n, avg({value}) AS point FROM {src} GROUP BY {keys}) LEFT JOIN (SELECT {keys}, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM ({_boot(keys, src, value)}) GROUP BY {keys}) USING ({keys})"


def behaviour(emb, table):
    rows = by_model(emb).join(emb.select("vec_id", (F.element_at("embedding", 9).cast("double") * 100).alias("displacement")), "vec_id")
    rows = rows.select("cluster", (F.col("label") % 2).alias("kind"), (F.col("vec_id") % 17).alias("track"), (F.col("vec_id") % 5).alias("bin"), "displacement")
    return J.behaviour_over_time(rows, "cluster", "kind", "track", "bin", "displacement", REPS, tables=[table])[table]


@query("p5_shares", "embeddings", f"SELECT kind, bin, cluster, count, sum(count) OVER (PARTITION BY kind, bin)::BIGINT AS total, count / sum(count) OVER (PARTITION BY kind, bin) AS share FROM (SELECT kind, bin, cluster, sum(count)::BIGINT AS count FROM {P5_COUNTS} GROUP BY 1, 2, 3)", "share")
def p5_shares(emb):
    return behaviour(emb, "shares")


@query("p5_subject_shares", "embeddings", f"SELECT * FROM {P5_SUBJECTS}", "share")
def p5_subjects(emb):
    return behaviour(emb, "subject_shares")


@query("p5_intervals", "embeddings", _interval("kind, bin, cluster", P5_SUBJECTS, "share"), "point lo hi")
def p5_intervals(emb):
    return behaviour(emb, "intervals")


@query("p5_ranks", "embeddings", f"SELECT * FROM {P5_RANKS}", "median")
def p5_ranks(emb):
    return behaviour(emb, "ranks")


@query("p5_efficient", "embeddings", f"SELECT bin, avg(CASE WHEN median >= (SELECT median(median) FROM {P5_RANKS}) THEN 100.0 ELSE 0 END) AS efficient, avg(CASE WHEN median < (SELECT median(median) FROM {P5_RANKS}) THEN 100.0 ELSE 0 END) AS inefficient FROM {EVENTS} JOIN {P5_RANKS} USING (cluster) GROUP BY 1", "efficient inefficient")
def p5_efficient(emb):
    return behaviour(emb, "efficient")


@query("p5_weighted", "embeddings", f"SELECT * FROM {P5_WEIGHTED}", "weighted")
def p5_weighted(emb):
    return behaviour(emb, "weighted")


@query("p5_weighted_intervals", "embeddings", _interval("kind, bin", P5_WEIGHTED, "weighted"), "point lo hi")
def p5_weighted_intervals(emb):
    return behaviour(emb, "weighted_intervals")


@query("p6_fly_recording", "frames", f"SELECT f.recording, f.track, f.frame, CASE WHEN f.frame > 10 AND f.frame <= 30 THEN 'on' ELSE 'off' END AS light, v.speed, round(sum(v.speed) OVER (PARTITION BY f.recording, f.track ORDER BY f.frame), 6) AS cumulated, f.grp AS genotype, 'female' AS sex, 3 AS age FROM frames f LEFT JOIN ({SG_SPEED}) v USING (recording, track, frame)", "speed cumulated")
def p6(frames):
    named = frames.withColumn("folder", F.concat("grp", F.lit("_f_3d")))
    return J.fly_recording(named, "folder", [("off", 10), ("on", 20)], 80.0).select("recording", "track", "frame", "light", "speed", F.round("cumulated", 6).alias("cumulated"), "metadata.genotype", "metadata.sex", "metadata.age")


@query("p7_name_harmonise", "names", "SELECT id, plain, row_number() OVER (PARTITION BY plain ORDER BY id) AS rank FROM (SELECT id, replace(replace(replace(coalesce(CASE name WHEN 'blue bolt (Brand#4)' THEN 'BB4' END, CASE WHEN name LIKE '%(Brand#4)' THEN 'B4' END, CASE WHEN name LIKE 'small ring (%' THEN 'SR' END, CASE WHEN lower(name) = 'hot gear (brand#3)' THEN 'HG3' END, name), '(', ''), ')', ''), ' ', '-') AS plain FROM names)")
def p7(names):
    return J.name_harmonise(names, name_map(names.sparkSession)).select("id", "plain", "rank")


@query("p8_inventory_audit", "paths", f"SELECT folder, count(*) AS n, count(*) FILTER (path LIKE '%.html') AS n_processed, CASE WHEN count(*) > count(*) FILTER (path LIKE '%.html') THEN count(*) FILTER (path LIKE '%.html') / (count(*) - count(*) FILTER (path LIKE '%.html')) ELSE 0 END AS ratio, count(*) FILTER (path LIKE '%#%') > 1 AS several, sum(size)::BIGINT AS size, bool_or(path LIKE '%.html') AS has_page, bool_or(path LIKE '%#%') AS has_anchor FROM {PATHS} GROUP BY 1", "ratio")
def p8(paths):
    return J.inventory_audit(files(paths), "folder", {"page": r"\.html$", "anchor": "#"})


PRUNED = "(SELECT *, row_number() OVER o AS r, first_value(x) OVER o AS x1 FROM (SELECT recording, frame, track AS instance, x, score FROM points WHERE node = 'thorax' AND x IS NOT NULL AND score >= 0.3) WINDOW o AS (PARTITION BY recording, frame ORDER BY score DESC, instance))"


@query("p9_instance_pruning", "points", f"SELECT recording, frame, instance, 'track_' || CAST(row_number() OVER (PARTITION BY recording, frame ORDER BY x, instance) AS STRING) AS name FROM (SELECT *, min(CASE WHEN r > 1 AND abs(x - x1) > 40 THEN r END) OVER (PARTITION BY recording, frame) AS second FROM {PRUNED}) WHERE r = 1 OR (r = second AND recording <> 0)")
def p9(points):
    return J.instance_pruning(points, "thorax", 0.3, 40.0, F.col("recording") == 0).select("recording", "frame", "instance", "name")

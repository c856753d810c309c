"""A2-A9, X27: kinematic and stimulus-locked summaries over the kin view (x, y as velocities)."""

from pyspark.sql import functions as F

from posekit.operators import joins, stim
from posekit.plans.registry import query

FLY = ["recording", "grp", "is_control", "track"]
LAB = "(SELECT k.*, p.on_index IS NOT NULL AS stim_on, p.on_index FROM kin k LEFT JOIN pulses p ON p.seq = 'long' AND k.time >= p.start_s AND k.time < p.end_s)"
WIN = "(SELECT k.*, p.on_index, floor((k.time - p.start_s) / 5.0) * 5.0 AS rb FROM kin k JOIN pulses p ON p.seq = 'long' AND k.time >= p.start_s - 10 AND k.time < p.start_s + 70 WHERE speed IS NOT NULL)"


def long_pulses(pulses):
    return pulses.where("seq = 'long'").drop("seq")


def labelled(kin, pulses):
    return joins.labelled_times(kin, long_pulses(pulses))


SUMMARY = """SELECT recording, grp, is_control, track, count(f) AS n_frames, avg(speed) AS mean_speed, avg(f) AS mean_forward_velocity,
  avg(CASE WHEN f > 0 THEN f END) AS mean_forward_speed, avg(CASE WHEN f < 0 THEN f END) AS mean_backward_speed, avg(CASE WHEN f < 0 THEN -f WHEN f >= 0 THEN 0 END) AS mean_backward_speed_rect,
  count(CASE WHEN f > 0 THEN 1 END) / greatest(count(f), 1) AS frac_forward, count(CASE WHEN f < 0 THEN 1 END) / greatest(count(f), 1) AS frac_backward, avg(abs(rotational_velocity)) AS mean_abs_rotational
  FROM (SELECT *, forward_velocity AS f FROM kin) GROUP BY 1, 2, 3, 4"""


@query("a2_per_fly", "kin", SUMMARY, "mean_speed mean_forward_velocity mean_forward_speed mean_backward_speed mean_backward_speed_rect frac_forward frac_backward mean_abs_rotational")
def a2(kin):
    return stim.per_fly(kin, FLY)


@query("a3_on_off", "kin pulses", f"SELECT recording, grp, is_control, track, avg(CASE WHEN stim_on THEN speed END) AS speed_on, avg(CASE WHEN NOT stim_on THEN speed END) AS speed_off, avg(CASE WHEN stim_on THEN forward_velocity END) AS forward_on, avg(CASE WHEN NOT stim_on THEN forward_velocity END) AS forward_off FROM {LAB} GROUP BY 1, 2, 3, 4", "speed_on speed_off forward_on forward_off")
def a3(kin, pulses):
    return stim.on_off(labelled(kin, pulses), FLY, {"speed": "speed", "forward": "forward_velocity"})


@query("a4_per_pulse", "kin pulses", f"SELECT recording, grp, is_control, track, on_index, avg(speed) AS speed, avg(forward_velocity) AS forward_velocity FROM {LAB} WHERE stim_on GROUP BY 1, 2, 3, 4, 5", "speed forward_velocity")
def a4(kin, pulses):
    return stim.per_pulse(labelled(kin, pulses), FLY, ["speed", "forward_velocity"])


@query("a5_path_integrals", "kin pulses", f"SELECT recording, grp, is_control, track, on_index, sum(greatest(-forward_velocity, 0) * dt) AS back_dist, sum(greatest(forward_velocity, 0) * dt) AS fwd_dist, sum(forward_velocity * dt) AS net_forward FROM {LAB} WHERE stim_on AND forward_velocity IS NOT NULL GROUP BY 1, 2, 3, 4, 5", "back_dist fwd_dist net_forward")
def a5(kin, pulses):
    return stim.path_integrals(labelled(kin, pulses), FLY)


@query("a6_onset_locked", "kin pulses", f"SELECT grp, recording, track, rb, avg(speed) AS speed FROM {WIN} GROUP BY 1, 2, 3, 4", "rb speed")
def a6(kin, pulses):
    return stim.psth(kin, long_pulses(pulses), "speed", 10.0, 70.0, 5.0, ["grp", "recording", "track"])


@query("a7_onset_locked_per_pulse", "kin pulses", f"SELECT grp, on_index, rb, avg(speed) AS speed FROM (SELECT grp, recording, track, on_index, rb, avg(speed) AS speed FROM {WIN} GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3", "rb speed")
def a7(kin, pulses):
    return stim.psth_per_pulse(kin, long_pulses(pulses), "speed", 10.0, 70.0, 5.0, ["recording", "track"], "grp")


BINS = [0.0, 200.0, 400.0, 600.0, 800.0]


@query("a8_fly_bin_matrix", "kin", "SELECT recording, track, " + ", ".join(f"avg(CASE WHEN time >= {b} AND time < {b + 200} THEN speed END) AS b{int(b)}" for b in BINS) + " FROM kin WHERE speed IS NOT NULL GROUP BY 1, 2", " ".join(f"b{int(b)}" for b in BINS))
def a8(kin):
    wide = stim.fly_matrix(stim.fly_bins(kin, "speed", 200.0, ["recording", "track"]), "speed", BINS, ["recording", "track"])
    return wide.toDF("recording", "track", *[f"b{int(b)}" for b in BINS])


@query("a9_control_reference", "kin", "SELECT tbin, avg(speed) AS reference FROM (SELECT recording, track, floor(time / 100.0) * 100.0 AS tbin, avg(speed) AS speed FROM kin WHERE is_control AND speed IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1", "tbin reference")
def a9(kin):
    return stim.control_reference(stim.fly_bins(kin, "speed", 100.0, ["recording", "track", "is_control"]), "speed")


@query("x27_protocol_intervals", "frames pulses", "SELECT seq, on_index, start_s, end_s, count(*) AS n_frames, count(DISTINCT track) AS n_tracks, sum(x) AS x FROM frames JOIN pulses ON time >= start_s AND time < end_s GROUP BY 1, 2, 3, 4", "start_s end_s x")
def x27(frames, pulses):
    """The frames in each on state of both protocols, whose intervals come from their steps."""
    on = stim.protocol_intervals(stim.protocol_steps(frames.sparkSession)).where("state = 'on'").drop("state", "pos")
    rows = joins.in_intervals(frames.select("track", "time", "x"), on, how="inner")
    return rows.groupBy("seq", "on_index", "start_s", "end_s").agg(F.count("*").alias("n_frames"), F.countDistinct("track").alias("n_tracks"), F.sum("x").alias("x"))

"""W1-W9, W12, W17-W19 over tracks of the frames view."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.functions import windows as W
from posekit.operators import stim
from posekit.plans.registry import query

KEY = ["recording", "track"]


def series():
    """The window of a track (made when a session exists)."""
    return Window.partitionBy(*KEY).orderBy("frame")


OVER = "PARTITION BY recording, track ORDER BY frame"
#: Gaps filled linearly by index, ends by the nearest value.
FILLED = f"""(SELECT recording, track, grp, frame, time, n, seen, v, coalesce(v, x0 + (x1 - x0) * (frame - i0) / nullif(i1 - i0, 0), x0, x1) AS x FROM (
  SELECT *, x AS v, count(*) OVER (PARTITION BY recording, track) AS n, count(x) OVER (PARTITION BY recording, track) AS seen,
    last_value(x IGNORE NULLS) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x0,
    last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0,
    first_value(x IGNORE NULLS) OVER ({OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1,
    first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER ({OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1
  FROM frames))"""


@query("w1_forward_fill", "frames", f"SELECT recording, track, frame, coalesce(last_value(x IGNORE NULLS) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS x FROM frames", "x")
def w1(frames):
    return frames.select(*KEY, "frame", W.forward_fill(F.col("x"), series()).alias("x"))


@query("w2_interpolate", "frames", f"SELECT recording, track, frame, x FROM {FILLED}", "x")
def w2(frames):
    return W.interpolated(frames.select(*KEY, "frame", "x"), "x", series(), "f").select(*KEY, "frame", F.col("f").alias("x"))


def filled(frames):
    return W.interpolated(frames.select(*KEY, "grp", "frame", "time", "x"), "x", series(), "x_filled")


def _fit_sql(window: int, order: int, derivative: int = 0) -> str:
    """Savitzky-Golay by joining every row to its window's rows, with regression weights inlined by offset."""
    h = window // 2
    values = ", ".join(f"({o}, {k - h}, {w!r})" for o in range(-h, h + 1) for k, w in enumerate(W.fit_weights(window, order, o, derivative)))
    return f"""SELECT a.recording, a.track, a.frame, sum(b.x * w.weight) AS s FROM
  (SELECT *, CASE WHEN frame <= {h} THEN {h} + 1 WHEN frame > n - {h} THEN n - {h} ELSE frame END AS centre FROM {FILLED} WHERE n >= {window}) a
  JOIN {FILLED} b ON a.recording = b.recording AND a.track = b.track AND b.frame BETWEEN a.centre - {h} AND a.centre + {h}
  JOIN (SELECT * FROM (VALUES {values}) AS v(off, k, weight)) w ON w.off = a.frame - a.centre AND w.k = b.frame - a.centre
  GROUP BY 1, 2, 3"""


@query("w3_savgol", "frames", _fit_sql(11, 2), "s")
def w3(frames):
    out = W.savgol(filled(frames), "x_filled", KEY, "frame", 11, 2, "s")
    return out.where("s IS NOT NULL").select(*KEY, "frame", "s")


@query("w3_moving_average", "frames", _fit_sql(21, 1), "s")
def w3b(frames):
    out = W.moving_average(filled(frames), "x_filled", KEY, "frame", 21, "s")
    return out.where("s IS NOT NULL").select(*KEY, "frame", "s")


#: Ten tracks end to end, as series that are longer than the widest window.
LONG = "(SELECT CAST(floor(track / 10) AS BIGINT) AS recording, 0 AS track, '' AS grp, row_number() OVER (PARTITION BY CAST(floor(track / 10) AS BIGINT) ORDER BY track, frame) AS frame, time, x FROM frames)"
LINES = f"""(SELECT *, avg(x) OVER w AS m, regr_slope(x, frame) OVER w AS b FROM {FILLED.replace("FROM frames", "FROM " + LONG)} WHERE n >= 221 WINDOW w AS (PARTITION BY recording ORDER BY frame ROWS BETWEEN 110 PRECEDING AND 110 FOLLOWING))"""
LONG_FIT = f"""SELECT recording, frame, CASE WHEN frame <= 110 THEN m1 + b1 * (frame - 111) WHEN frame > n - 110 THEN m2 + b2 * (frame - n + 110) ELSE m END AS s FROM {LINES}
  JOIN (SELECT recording, max(CASE WHEN frame = 111 THEN m END) AS m1, max(CASE WHEN frame = 111 THEN b END) AS b1, max(CASE WHEN frame = n - 110 THEN m END) AS m2, max(CASE WHEN frame = n - 110 THEN b END) AS b2 FROM {LINES} GROUP BY 1) USING (recording)"""


@query("w3_savgol_long", "frames", LONG_FIT, "s")
def w3c(frames):
    """The default window (221, 1) over ten tracks end to end; a series too short for it has no smoothed value."""
    ten = F.floor(F.col("track") / 10)
    row = F.row_number().over(Window.partitionBy(ten).orderBy("track", "frame"))
    ends = frames.select(ten.alias("recording"), row.alias("frame"), "x")
    filled_in = W.interpolated(ends, "x", Window.partitionBy("recording").orderBy("frame"), "f")
    out = W.moving_average(filled_in, "f", ["recording"], "frame", 221, "s")
    return out.where("s IS NOT NULL").select("recording", "frame", "s")


def _short_fit_sql(window: int, order: int) -> str:
    """Savitzky-Golay of series shorter than the window, by the widest odd window that fits: weights by length, row and value."""
    values = []
    for n in range(1, window):
        width = n - (n + 1) % 2
        for i in range(n if width > order else 0):
            centre = min(max(i, width // 2), n - 1 - width // 2)
            values += [f"({n}, {i + 1}, {centre - width // 2 + k + 1}, {w!r})" for k, w in enumerate(W.fit_weights(width, order, i - centre))]
    return f"""SELECT a.recording, a.track, a.frame, sum(b.x * w.weight) AS s FROM {FILLED} a JOIN (SELECT * FROM (VALUES {", ".join(values)}) AS v(n, i, k, weight)) w ON w.n = a.n AND w.i = a.frame
  JOIN {FILLED} b ON a.recording = b.recording AND a.track = b.track AND b.frame = w.k GROUP BY 1, 2, 3"""


SMOOTHED = f"SELECT f.recording, f.track, f.frame, CASE WHEN seen < 3 THEN v ELSE coalesce(l.s, t.s, f.x) END AS s FROM {FILLED} f LEFT JOIN ({_fit_sql(11, 1)}) l USING (recording, track, frame) LEFT JOIN ({_short_fit_sql(11, 1)}) t USING (recording, track, frame)"


@query("w4_clamped_smooth", "frames", SMOOTHED, "s")
def w4(frames):
    """All tracks, those of 3 to 10 rows with a window that fits them."""
    return stim.smoothed(frames.select(*KEY, "frame", "x"), ["x"], KEY, "frame", 11, 1).select(*KEY, "frame", F.col("x").alias("s"))


@query("w5_gradient", "frames", f"SELECT recording, track, frame, 80 * CASE WHEN l IS NULL THEN r - x WHEN r IS NULL THEN x - l ELSE (r - l) / 2 END AS g FROM (SELECT *, lag(x) OVER ({OVER}) AS l, lead(x) OVER ({OVER}) AS r FROM {FILLED} f)", "g")
def w5(frames):
    return filled(frames).select(*KEY, "frame", (W.gradient(F.col("x_filled"), series()) * 80).alias("g"))


@query("w6_unwrap", "frames", f"SELECT recording, track, frame, a - 2 * pi() * sum(CASE WHEN step > pi() THEN 1 WHEN step < -pi() THEN -1 ELSE 0 END) OVER ({OVER}) AS u FROM (SELECT *, a - lag(a) OVER ({OVER}) AS step FROM (SELECT *, atan2(y - 50, x - 50) AS a FROM frames WHERE x IS NOT NULL AND y IS NOT NULL)) UNION ALL SELECT recording, track, frame, NULL FROM frames WHERE x IS NULL OR y IS NULL", "u")
def w6(frames):
    angles = frames.withColumn("a", S.angle(F.col("y") - 50, F.col("x") - 50))
    return W.unwrapped(angles, "a", KEY, "frame", "u").select(*KEY, "frame", "u")


SG_SPEED = f"SELECT dx.recording, dx.track, dx.frame, sqrt(dx.s ** 2 + dy.s ** 2) * 80.0 * 32 / 832 AS speed FROM ({_fit_sql(25, 2, 1)}) dx JOIN ({_fit_sql(25, 2, 1).replace('FROM frames', 'FROM (SELECT * REPLACE (y AS x) FROM frames)')}) dy USING (recording, track, frame)"


@query("w7_sg_speed", "frames", SG_SPEED, "speed")
def w7(frames):
    return stim.sg_speed(frames, KEY, "frame", fps=80.0).where("speed IS NOT NULL").select(*KEY, "frame", "speed")


@query("w8_running_total", "frames", f"SELECT recording, track, frame, sum(x) OVER ({OVER}) AS total FROM frames", "total")
def w8(frames):
    return frames.select(*KEY, "frame", W.running_total(F.col("x"), series()).alias("total"))


@query("w9_bins", "frames", "SELECT recording, track, frame, CAST(greatest(ceil((time - mn) / (mx - mn) * 12) - 1, 0) AS INT) AS bin, CAST(CASE WHEN time > 0 AND time <= 60 THEN 0 WHEN time > 60 AND time <= 300 THEN 1 WHEN time > 300 AND time <= 900 THEN 2 END AS INT) AS edge_bin FROM frames, (SELECT min(time) AS mn, max(time) AS mx FROM frames)")
def w9(frames):
    out = W.equal_bins(frames, "time", 12, "bin")
    return out.select(*KEY, "frame", "bin", W.edge_bins(F.col("time"), [0.0, 60.0, 300.0, 900.0]).alias("edge_bin"))


@query("w12_rolling_median", "frames", f"SELECT recording, track, frame, coalesce(first_value(m IGNORE NULLS) OVER ({OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(m IGNORE NULLS) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS m FROM (SELECT *, CASE WHEN count(x) OVER w = 5 THEN quantile_cont(x, 0.5) OVER w END AS m FROM frames WINDOW w AS ({OVER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))", "m")
def w12(frames):
    med = frames.withColumn("med", W.rolling_median(F.col("x"), series()))
    return W.fill_back_then_forward(med, "med", series(), "m").select(*KEY, "frame", "m")


@query("w17_group_sum", "ev", "SELECT event_id, sum(displacement) OVER (PARTITION BY fly) AS total, displacement / sum(displacement) OVER (PARTITION BY fly) AS share FROM ev", "total share")
def w17(ev):
    total = F.sum("displacement").over(Window.partitionBy("fly"))
    return ev.select("event_id", total.alias("total"), F.try_divide(F.col("displacement"), total).alias("share"))


@query("w18_light_states", "frames", "SELECT recording, track, frame, CASE WHEN frame <= 10 THEN 'off' WHEN frame <= 25 THEN 'on' WHEN frame <= 40 THEN 'off' ELSE 'off' END AS light FROM frames")
def w18(frames):
    return stim.light_states(frames, [("off", 10), ("on", 15), ("off", 15)], KEY, "frame", strict=False).select(*KEY, "frame", "light")


@query("w19_differences", "frames", f"SELECT recording, track, frame, x - lag(x) OVER ({OVER}) AS diff, lead(x) OVER ({OVER}) AS next FROM frames", "diff next")
def w19(frames):
    return frames.select(*KEY, "frame", (F.col("x") - F.lag("x").over(series())).alias("diff"), F.lead("x").over(series()).alias("next"))

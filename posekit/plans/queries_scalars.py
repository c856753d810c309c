"""X1, X4, X5, X7-X11, X26."""

from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.plans.registry import query

KEY = ["recording", "track", "frame"]
WIDE = "(SELECT recording, track, frame, max(CASE WHEN node = 'head' THEN x END) AS hx, max(CASE WHEN node = 'head' THEN y END) AS hy, max(CASE WHEN node = 'abdomen' THEN x END) AS ax, max(CASE WHEN node = 'abdomen' THEN y END) AS ay FROM points GROUP BY 1, 2, 3)"


@query("x1_distance", "frames", "SELECT recording, track, frame, sqrt((x - 50) ** 2 + (y - 50) ** 2) AS d FROM frames", "d")
def x1(frames):
    return frames.select(*KEY, S.distance("x", "y", F.lit(50.0), F.lit(50.0)).alias("d"))


@query("x4_body_axis", "points", f"SELECT recording, track, frame, degrees(atan2(hy - ay, hx - ax)) AS heading, (3 * (hx - ax) + 4 * (hy - ay)) / l AS forward, (-3 * (hy - ay) + 4 * (hx - ax)) / l AS sideways, greatest(-(3 * (hx - ax) + 4 * (hy - ay)) / l, 0) AS backward FROM (SELECT *, nullif(sqrt((hx - ax) ** 2 + (hy - ay) ** 2), 0) AS l FROM {WIDE} WHERE hx IS NOT NULL)", "heading forward sideways backward")
def x4(points):
    pick = lambda n, c: F.max(F.when(F.col("node") == n, F.col(c)))
    w = points.groupBy(*KEY).agg(pick("head", "x").alias("hx"), pick("head", "y").alias("hy"), pick("abdomen", "x").alias("ax"), pick("abdomen", "y").alias("ay")).where("hx IS NOT NULL")
    ux, uy = S.axis_unit("hx", "hy", "ax", "ay")
    w = w.withColumns({"ux": ux, "uy": uy})
    fv = S.forward(F.lit(3.0), F.lit(4.0), "ux", "uy")
    return w.select(*KEY, S.heading_deg("hx", "hy", "ax", "ay").alias("heading"), fv.alias("forward"), S.lateral(F.lit(3.0), F.lit(4.0), "ux", "uy").alias("sideways"), S.backward_speed(fv).alias("backward"))


@query("x5_time_conversions", "ev", "SELECT event_id, CAST(round_even(event_id / 30.0, 0) AS BIGINT) AS seconds, event_id // 3600 AS h, event_id % 3600 // 60 AS m, event_id % 60 AS s, CAST(round_even(event_id * 1.5, 0) AS BIGINT) AS frames, event_id AS back FROM ev")
def x5(ev):
    clock = S.seconds_to_clock("event_id")
    text = F.concat_ws(":", clock["h"].cast("string"), clock["m"].cast("string"), clock["s"].cast("string"))
    return ev.select("event_id", S.frames_to_seconds("event_id", 30).alias("seconds"), clock["h"].alias("h"), clock["m"].alias("m"), clock["s"].alias("s"), S.seconds_to_frames("event_id", 1.5).alias("frames"), S.clock_to_seconds(text).alias("back"))


@query("x7_signed_distance", "frames", "SELECT recording, track, frame, x - y AS signed, abs(x - y) < 20 AS close FROM frames", "signed")
def x7(frames):
    d = F.col("x") - F.col("y")
    return frames.select(*KEY, d.alias("signed"), (F.abs(d) < 20).alias("close"))


@query("x8_circle", "ev", "SELECT event_id, ux, uy, sqrt(ux ** 2 + uy ** 2) AS r FROM (SELECT event_id, (100 * (c - 10) + 10 * 0 + 0) / 1.0 * 0 + 5.0 AS ux, CASE WHEN c = 0 THEN NULL ELSE ((c * c + 9) - 30) / (2.0 * c) END AS uy FROM (SELECT event_id, CAST(event_id % 20 AS DOUBLE) AS c FROM ev)) WHERE uy IS NOT NULL", "ux uy r")
def x8(ev):
    """Through (0, 0), (10, 0) and (3, c): the centre lies on x = 5."""
    c = F.col("event_id") % 20
    out = ev.select("event_id", S.circle(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(3.0), c.cast("double")).alias("o"))
    return out.where("o.cy IS NOT NULL").select("event_id", F.col("o.cx").alias("ux"), F.col("o.cy").alias("uy"), F.col("o.r").alias("r"))


@query("x9_transforms", "points", "SELECT recording, track, frame, node, (x - 20) * (640 / 56.0) AS px, y * ((480 - 74) / 516.0) + 74 AS py, y AS rx, 640 - x AS ry FROM points", "px py rx ry")
def x9(points):
    px, py = S.undo_template("x", "y", 640, 480)
    rx, ry = S.rotate_270("x", "y", 640)
    return points.select(*KEY, "node", px.alias("px"), py.alias("py"), rx.alias("rx"), ry.alias("ry"))


@query("x10_log_displacement", "ev", "SELECT event_id, ln(1 + displacement) AS logged FROM ev", "logged")
def x10(ev):
    return ev.select("event_id", F.log1p("displacement").alias("logged"))


@query("x11_fill_missing", "frames", "SELECT recording, track, frame, coalesce(x, 9999.0) AS x FROM frames", "x")
def x11(frames):
    return frames.na.fill(9999.0, ["x"]).select(*KEY, "x")


@query("x26_node_side", "points", "SELECT DISTINCT concat(chr(CAST(76 + track % 8 AS INT)), node) AS node, CASE WHEN track % 8 = 6 THEN 'right' WHEN track % 8 = 0 THEN 'left' ELSE 'other' END AS side FROM points")
def x26(points):
    named = points.select(F.concat(F.char(F.lit(76) + F.col("track") % 8), "node").alias("node")).distinct()
    return named.select("node", S.side_of_node("node").alias("side"))

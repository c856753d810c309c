"""Kinematics and stimulus-locked summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.functions import windows as W
from posekit.operators.filters import resolve_node
from posekit.operators.joins import onset_windows

# Fixed values: (state, milliseconds) of the two protocols.
PROTOCOLS = {
    "short": [("off", 500), *[("on", 60_000), ("off", 15_000)] * 4, ("on", 60_000)],
    "long": [("off", 500), *([*[("on", 60_000), ("off", 15_000)] * 4, ("on", 60_000), ("off", 300_000)] * 3)],
}
FLY = ["recording", "grp", "is_control", "track"]


def protocol_steps(spark: SparkSession, protocols: dict[str, list[tuple[str, int]]] | None = None) -> DataFrame:
    rows = [(seq, k, state, ms) for seq, steps in (protocols or PROTOCOLS).items() for k, (state, ms) in enumerate(steps)]
    return spark.createDataFrame(rows, "seq string, pos int, state string, ms long")


def protocol_intervals(steps: DataFrame) -> DataFrame:
    """(seq, state, start_s, end_s, on_index): on_index from 1 for on states, else null."""
    w = Window.partitionBy("seq").orderBy("pos").rowsBetween(*W.PAST)
    end = F.sum("ms").over(w)
    on = F.sum((F.col("state") == "on").cast("int")).over(w)
    return steps.select("seq", "pos", "state", ((end - F.col("ms")) / 1000).alias("start_s"), (end / 1000).alias("end_s"), F.when(F.col("state") == "on", on).cast("int").alias("on_index"))


def protocol_totals(steps: DataFrame) -> DataFrame:
    return steps.groupBy("seq").agg((F.sum("ms") / 1000).alias("total_s"), F.sum((F.col("state") == "on").cast("int")).alias("n_on"))


def shared_prefix(steps: DataFrame, a: str, b: str) -> DataFrame:
    """One row: seconds for which two protocols run alike."""
    one = steps.where(F.col("seq") == a).select("pos", F.col("state").alias("s1"), F.col("ms").alias("m1"))
    two = steps.where(F.col("seq") == b).select("pos", F.col("state").alias("s2"), F.col("ms").alias("m2"))
    w = Window.partitionBy("g").orderBy("pos").rowsBetween(*W.PAST)
    both = one.join(two, "pos").withColumn("g", F.lit(0))  # as many rows as a protocol has steps
    alike = both.withColumn("ok", F.min(((F.col("s1") == F.col("s2")) & (F.col("m1") == F.col("m2"))).cast("int")).over(w) == 1)
    return alike.agg((F.coalesce(F.sum(F.when(F.col("ok"), F.col("m1"))), F.lit(0)) / 1000).alias("shared_s"))


def smoothed(df: DataFrame, columns: list[str], keys: list[str], order_by: str, window: int, order: int) -> DataFrame:
    """Columns filled over gaps and smoothed; series under 3 values stay, those no window longer than `order` fits are only filled.

    A series shorter than the window is smoothed by the widest odd window that fits it.
    """
    named = lambda tag: {c: f"_{tag}{k}" for k, c in enumerate(columns)}
    filled = named("f")
    df = W.interpolated_columns(df, filled, Window.partitionBy(*keys).orderBy(order_by))
    fits = {filled[c]: s for c, s in named("s").items()}
    df = W.moving_average_columns(df, fits, keys, order_by, window) if order <= 1 else W.savgol_columns(df, fits, keys, order_by, window, order)
    short = {filled[c]: s for c, s in named("t").items()}
    df = W.clamped_columns(df, short, keys, order_by, window, order)
    df = df.withColumns({x: F.count(c).over(Window.partitionBy(*keys)) for c, x in named("k").items()})
    out = {c: F.when(F.col(f"_k{k}") < 3, F.col(c)).otherwise(F.coalesce(f"_s{k}", f"_t{k}", f"_f{k}")) for k, c in enumerate(columns)}
    return df.withColumns(out).drop(*[x for tag in "fstk" for x in named(tag).values()])


def sg_speed(frames: DataFrame, keys: list[str], order_by: str, fps: float, window: int = 25, order: int = 2) -> DataFrame:
    """Speed in mm/s from first derivatives of the smoothed track."""
    frames = W.interpolated_columns(frames, {"x": "_x", "y": "_y"}, Window.partitionBy(*keys).orderBy(order_by))
    frames = W.savgol_columns(frames, {"_x": "_dx", "_y": "_dy"}, keys, order_by, window, order, derivative=1)
    return frames.withColumn("speed", F.hypot("_dx", -F.col("_dy")) * fps * S.PX_TO_MM).drop("_x", "_y", "_dx", "_dy")


def end_of(steps: list[tuple[str, int]]) -> int:
    return sum(frames for _, frames in steps)


def light_states(df: DataFrame, steps: list[tuple[str, int]], keys: list[str], order_by: str, strict: bool = True) -> DataFrame:
    """Light state by frame count; off after the last step. strict: steps longer than a series raise an error."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order_by))
    out, end, edges = F.lit("off"), 0, []
    for state, frames in steps:
        end += frames
        edges.append((end, state))
    for end, state in reversed(edges):
        out = F.when(F.col("_r") <= end, state).otherwise(out)
    if strict:
        length = F.count("*").over(Window.partitionBy(*keys))
        out = F.when(length < end_of(steps), F.raise_error(F.concat(F.lit(f"the light sequence has {end_of(steps)} frames, a series only "), length.cast("string")))).otherwise(out)
    return df.withColumn("_r", n).withColumn("light", out).drop("_r")


def kinematics(wide: DataFrame, keys: list[str], order_by: str, fps: float, window: int, order: int, centroid: list[str], head: str = "head", abdomen: str = "abdomen", px_per_mm: float | None = None) -> DataFrame:
    """Centroid, heading and velocities of wide rows (x_<node>, y_<node>); null where no centroid node was seen.

    Node names are found with case ignored. All windows share one partitioning
    (the track), so there is one exchange.
    """
    if not fps or fps <= 0:
        raise ValueError("fps must be a positive number")
    known = [c[2:] for c in wide.columns if c.startswith("x_")]
    centroid, head, abdomen = [resolve_node(known, n) for n in centroid], resolve_node(known, head), resolve_node(known, abdomen)
    nodes = list(dict.fromkeys([*centroid, head, abdomen]))
    seen = F.coalesce(*[F.col(f"x_{n}") for n in centroid]).isNotNull()
    df = smoothed(wide.withColumn("_seen", seen), [f"{a}_{n}" for n in nodes for a in "xy"], keys, order_by, window, order)
    w = Window.partitionBy(*keys).orderBy(order_by)
    mean = lambda a: sum((F.coalesce(F.col(f"{a}_{n}"), F.lit(0.0)) for n in centroid), F.lit(0.0)) / F.nullif(sum((F.col(f"{a}_{n}").isNotNull().cast("int") for n in centroid), F.lit(0)), F.lit(0))
    ux, uy = S.axis_unit(f"x_{head}", f"y_{head}", f"x_{abdomen}", f"y_{abdomen}")
    df = df.withColumns({"_cx": mean("x"), "_cy": mean("y"), "_ux": ux, "_uy": uy})
    df = df.withColumns({"_vx": W.gradient(F.col("_cx"), w) * fps, "_vy": W.gradient(F.col("_cy"), w) * fps, "_h": F.when(F.col("_ux").isNotNull(), F.atan2("_uy", "_ux"))})
    df = W.unwrapped(df, "_h", keys, order_by, "_hu")
    scale = 1.0 / px_per_mm if px_per_mm else 1.0
    fv = S.forward("_vx", "_vy", "_ux", "_uy") * scale
    out = {
        "centroid_x": F.col("_cx") * scale, "centroid_y": F.col("_cy") * scale, "heading_deg": F.degrees("_h"),
        "speed": F.hypot("_vx", "_vy") * scale, "forward_velocity": fv, "backward_speed": S.backward_speed(fv),
        "lateral_velocity": S.lateral("_vx", "_vy", "_ux", "_uy") * scale, "rotational_velocity": F.degrees(W.gradient(F.col("_hu"), w) * fps),
    }
    df = df.withColumns({k: F.when(F.col("_seen"), v) for k, v in out.items()})
    return df.withColumn("units", F.lit("mm/s" if px_per_mm else "px/s")).drop("_seen", "_cx", "_cy", "_ux", "_uy", "_vx", "_vy", "_h", "_hu")


def per_fly(kin: DataFrame, keys: list[str]) -> DataFrame:
    """Summary of each fly; missing keys are groups of their own."""
    fv, n = F.col("forward_velocity"), F.greatest(F.count("forward_velocity"), F.lit(1))
    return kin.groupBy(*keys).agg(
        F.count("forward_velocity").alias("n_frames"),
        F.avg("speed").alias("mean_speed"),
        F.avg(fv).alias("mean_forward_velocity"),
        F.avg(F.when(fv > 0, fv)).alias("mean_forward_speed"),
        F.avg(F.when(fv < 0, fv)).alias("mean_backward_speed"),
        F.avg(S.backward_speed(fv)).alias("mean_backward_speed_rect"),
        (F.sum(F.when(fv > 0, 1).otherwise(0)) / n).alias("frac_forward"),
        (F.sum(F.when(fv < 0, 1).otherwise(0)) / n).alias("frac_backward"),
        F.avg(F.abs("rotational_velocity")).alias("mean_abs_rotational"),
    )


def on_off(kin: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Means of columns (by short name) with the stimulus on and off."""
    return kin.groupBy(*keys).agg(*[F.avg(F.when(flag, F.col(c))).alias(f"{short}_{s}") for short, c in columns.items() for s, flag in (("on", F.col("stim_on")), ("off", ~F.col("stim_on")))])


def per_pulse(kin: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return kin.where(F.col("stim_on") & F.col("on_index").isNotNull()).groupBy(*keys, "on_index").agg(*[F.avg(c).alias(c) for c in columns])


def path_integrals(kin: DataFrame, keys: list[str]) -> DataFrame:
    """Backward, forward and net distance of each pulse."""
    fv, dt = F.col("forward_velocity"), F.col("dt")
    rows = kin.where(F.col("stim_on") & F.col("on_index").isNotNull()).dropna(subset=["forward_velocity", "dt"])
    return rows.groupBy(*keys, "on_index").agg(F.sum(F.greatest(-fv, F.lit(0.0)) * dt).alias("back_dist"), F.sum(F.greatest(fv, F.lit(0.0)) * dt).alias("fwd_dist"), F.sum(fv * dt).alias("net_forward"))


def psth(kin: DataFrame, pulses: DataFrame, metric: str, pre: float, post: float, bin_s: float, keys: list[str]) -> DataFrame:
    """Mean by fly and relative bin, pulses pooled."""
    rows = onset_windows(kin.where(F.col(metric).isNotNull()), pulses, pre, post)
    return rows.groupBy(*keys, (F.floor(F.col("rel") / bin_s) * bin_s).alias("rb")).agg(F.avg(metric).alias(metric))


def psth_per_pulse(kin: DataFrame, pulses: DataFrame, metric: str, pre: float, post: float, bin_s: float, keys: list[str], group: str) -> DataFrame:
    """Mean over flies of their means, by group, pulse and relative bin."""
    rows = onset_windows(kin.where(F.col(metric).isNotNull()), pulses, pre, post).withColumn("rb", F.floor(F.col("rel") / bin_s) * bin_s)
    fly = rows.groupBy(*dict.fromkeys([group, *keys]), "on_index", "rb").agg(F.avg(metric).alias(metric))
    return fly.groupBy(group, "on_index", "rb").agg(F.avg(metric).alias(metric))


def fly_bins(kin: DataFrame, metric: str, bin_s: float, keys: list[str]) -> DataFrame:
    """Long form: mean by fly and time bin."""
    return kin.where(F.col(metric).isNotNull()).groupBy(*keys, (F.floor(F.col("time") / bin_s) * bin_s).alias("tbin")).agg(F.avg(metric).alias(metric))


def fly_matrix(binned: DataFrame, metric: str, bins: list[float], keys: list[str]) -> DataFrame:
    """Wide form on a common grid; missing cells are null. For a stated list of bins only."""
    if len(bins) > 1000:
        raise ValueError("keep the long form for more than 1,000 bins")
    return binned.groupBy(*keys).pivot("tbin", bins).agg(F.first(metric))


def control_reference(binned: DataFrame, metric: str, control: str = "is_control") -> DataFrame:
    return binned.where(F.col(control)).groupBy("tbin").agg(F.avg(metric).alias("reference"))

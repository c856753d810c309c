"""Track quality, overlap and identity.

Scores, shares and distances are rounded to nine decimals before they are
compared or ranked: an average depends on the order of its rows in the last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.operators.joins import track_pairs


def track_stats(points: DataFrame, n_frames: DataFrame, recording: str = "recording", track: str = "track") -> DataFrame:
    """Frames present, occupancy, mean score over present frames (instance, else point score, else 1; 0 if never present)."""
    instance = F.max("instance_score") if "instance_score" in points.columns else F.lit(None).cast("double")
    frames = points.groupBy(recording, track, "frame").agg(F.max(F.col("x").isNotNull() | F.col("y").isNotNull()).alias("present"), instance.alias("instance"), F.avg("score").alias("point"))
    n = F.count_if("present")
    score = lambda c: F.avg(F.when(F.col("present"), F.col(c)))
    out = frames.groupBy(recording, track).agg(n.alias("n_present"), F.round(F.when(n == 0, F.lit(0.0)).otherwise(F.coalesce(score("instance"), score("point"), F.lit(1.0))), 9).alias("mean_score"))
    return out.join(n_frames, recording).withColumn("occupancy", F.round(F.coalesce(F.try_divide(F.col("n_present").cast("double"), F.col("n_frames")), F.lit(0.0)), 9))


def centroids(points: DataFrame, recording: str = "recording", track: str = "track") -> DataFrame:
    """Mean of the nodes present, by frame; absent frames left out."""
    out = points.groupBy(recording, track, "frame").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return out.where(F.col("cx").isNotNull() | F.col("cy").isNotNull())


def ranked(stats: DataFrame, least_occupancy: float, least_score: float, recording: str = "recording", track: str = "track") -> DataFrame:
    """Tracks that qualify, best first: by score, occupancy, then track."""
    ok = stats.where((F.col("occupancy") >= least_occupancy) & (F.col("mean_score") >= least_score))
    w = Window.partitionBy(recording).orderBy(F.desc("mean_score"), F.desc("occupancy"), track)
    return ok.withColumn("rank", F.row_number().over(w))


def overlaps(kept: DataFrame, cents: DataFrame, distance: float, fraction: float, recording: str = "recording", track: str = "track") -> DataFrame:
    """(recording, a, b): kept track a lies within a distance of better track b in a fraction of a's present frames.

    At most the kept tracks of a recording meet in a frame, so pairs stay few.
    """
    rows = cents.join(kept.select(recording, track, "rank"), [recording, track]).withColumnRenamed(track, "track")
    near = track_pairs(rows, [recording, "frame"]).withColumn("near", F.round(S.distance("ax", "ay", "bx", "by"), 9) < distance)
    n = rows.groupBy(recording, F.col("track").alias("a")).agg(F.count("*").alias("n_a"))
    share = near.groupBy(recording, "a", "b", "ra", "rb").agg(F.count_if("near").alias("n_near")).join(n, [recording, "a"])
    return share.withColumn("share", F.round(F.col("n_near") / F.greatest("n_a", F.lit(1)), 9)).where(F.col("share") >= fraction)


def select_tracks(points: DataFrame, n_frames: DataFrame, least_score: float = 0.3, least_occupancy: float = 0.5, most: int = 3, overlap_distance: float = 20.0, overlap_fraction: float = 0.7) -> DataFrame:
    """Every track with kept and reason. Overlaps are checked against surviving better tracks; freed places are not refilled."""
    stats = track_stats(points, n_frames)
    order = ranked(stats, least_occupancy, least_score)
    kept = order.where(F.col("rank") <= most)
    pairs = overlaps(kept, centroids(points), overlap_distance, overlap_fraction).groupBy("recording").agg(F.collect_list(F.struct("ra", "rb")).alias("pairs"))
    # A fold over the ranks (at most `most`): a rank survives unless it overlaps a surviving better one.
    ranks = kept.groupBy("recording").agg(F.array_sort(F.collect_list("rank")).alias("ranks")).join(pairs, "recording", "left")
    hit = lambda r, b: F.exists(F.col("pairs"), lambda p: (p["ra"] == r) & (p["rb"] == b))
    fold = F.aggregate("ranks", F.array().cast("array<int>"), lambda acc, r: F.when(F.coalesce(F.exists(acc, lambda b: hit(r, b)), F.lit(False)), acc).otherwise(F.concat(acc, F.array(r))))
    survivors = ranks.select("recording", fold.alias("survivors"), "pairs")
    out = stats.join(order.select("recording", "track", "rank"), ["recording", "track"], "left").join(survivors, "recording", "left")
    is_kept = F.coalesce(F.array_contains("survivors", F.col("rank")), F.lit(False))
    by = F.array_min(F.filter("survivors", lambda b: hit(F.col("rank"), b)))
    better = kept.select("recording", F.col("rank").alias("_by"), F.col("track").alias("_name"))
    out = out.withColumns({"kept": is_kept, "_by": F.when(~is_kept & (F.col("rank") <= most), by)}).join(better, ["recording", "_by"], "left")
    few, low = F.col("occupancy") < least_occupancy, F.col("mean_score") < least_score
    # The reasons.
    reason = (
        F.when(F.col("kept"), "present + confident")
        .when(F.col("_name").isNotNull(), F.concat(F.lit("overlaps higher-score track '"), F.col("_name").cast("string"), F.lit("'")))
        .when(few & low, "short + low-score parasite")
        .when(few, f"occupancy < {least_occupancy:.0%}")
        .when(low, f"score < {least_score}")
        .otherwise(f"exceeds max_tracks={most}")
    )
    return out.withColumn("reason", reason).select("recording", "track", "occupancy", "mean_score", "n_present", "kept", "reason")


def two_best(instances: DataFrame, keys: list[str], gap: float = 90.0, most: int = 2) -> DataFrame:
    """Per frame the best instance and the next best more than `gap` away in x, named track_1, track_2 from left to right."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "instance")
    rows = instances.withColumns({"_r": F.row_number().over(w), "_x": F.first("x").over(w)})
    far = (F.col("_r") > 1) & (F.abs(F.col("x") - F.col("_x")) > gap)
    second = F.min(F.when(far, F.col("_r"))).over(Window.partitionBy(*keys))
    chosen = rows.withColumn("_s", second if most > 1 else F.lit(1)).where((F.col("_r") == 1) | (F.col("_r") == F.col("_s"))).drop("_s")
    return named_by_x(chosen.drop("_r", "_x"), keys)


def named_by_x(instances: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """track_1, track_2, ... by x in each frame; or the two names given, from left to right."""
    w = Window.partitionBy(*keys).orderBy("x", "instance")
    if names is None:
        return instances.withColumn("name", F.concat(F.lit("track_"), F.row_number().over(w).cast("string")))
    if len(names) != 2:
        raise ValueError(f"there should be exactly two tracks, not {len(names)}")
    return instances.withColumn("name", F.get(F.array(*[F.lit(n) for n in names]), F.row_number().over(w) - 1))

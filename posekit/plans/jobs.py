"""User-level jobs composed from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.functions import windows as W
from posekit.operators import aggregates as A
from posekit.operators import filters, joins, learn, naming, stats, stim, tracks
from posekit.sources import io


def clean_tracks(points: DataFrame, n_frames: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(kept points, report). A recording that would keep nothing is flagged in the report and keeps no rows."""
    report = tracks.select_tracks(points, n_frames, **limits)
    report = report.withColumn("empty_recording", ~F.bool_or("kept").over(Window.partitionBy("recording")))
    kept = report.where("kept").select("recording", "track")
    return points.join(kept, ["recording", "track"], "left_semi"), report


def keep_in_tensor(recordings: DataFrame, kept: DataFrame) -> DataFrame:
    """Nested arrays cut to the kept track numbers (from 0; at most a few a recording)."""
    k = kept.groupBy("recording").agg(F.array_sort(F.collect_list("index")).alias("_k"))
    return recordings.join(k, "recording").withColumn("tracks", F.transform("_k", lambda i: F.get("tracks", i))).drop("_k")


def track_kinematics(points: DataFrame, nodes: list[str], fps: float, window: int, order: int, centroid: list[str], px_per_mm: float | None = None) -> DataFrame:
    """Kinematics of every track from point rows."""
    keys = ["recording", "track"]
    wide = points.groupBy(*keys, "frame").pivot("node", nodes).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    wide = wide.toDF(*keys, "frame", *[f"{a}_{n}" for n in nodes for a in "xy"])
    out = stim.kinematics(wide, keys, "frame", fps, window, order, centroid, px_per_mm=px_per_mm)
    return out.withColumns({"time": F.col("frame") / fps, "dt": F.lit(1.0 / fps)})


def per_fly_speed(points: DataFrame, labels: DataFrame, nodes: list[str], fps: float, window: int, order: int, centroid: list[str], px_per_mm: float | None = None) -> DataFrame:
    """How fast each fly walks along its body axis, forward and backward, and how fast it turns; with its group.

    labels: recording, track, grp, is_control, one row a track; tracks without labels are groups of their own.
    """
    kin = track_kinematics(points, nodes, fps, window, order, centroid, px_per_mm)
    keys = ["recording", "track"]
    return stim.per_fly(kin, keys).join(labels.select(*keys, "grp", "is_control"), keys, "left")


#: Metrics of a fly: the column of a frame, and its summary.
METRICS = {"speed": "mean_speed", "forward_velocity": "mean_forward_velocity", "backward_speed": "mean_backward_speed_rect", "rotational_velocity": "mean_abs_rotational"}
#: Seconds for which the protocols run alike.
SHARED_END = 360.5


def labelled_kinematics(points: DataFrame, recordings: DataFrame, pulses: DataFrame, nodes: list[str], fps: float, window: int, order: int, centroid: list[str], px_per_mm: float | None = None, tokens: list[str] = (), most_tracks: int = 0) -> DataFrame:
    """Frames of a collection with kinematics, group, protocol and stimulus state.

    recordings: (recording, path); the genotype is the third folder above a
    file, the protocol the fourth. Recordings whose genotype holds a token, or
    that have more than most_tracks tracks (0: no limit), are left out; those of
    an unknown protocol have no stimulus.
    """
    known = recordings.select("recording", S.parent("path", 3).alias("genotype"), S.protocol_of(S.parent("path", 4)).alias("sequence"))
    known = filters.without_tokens(known, "genotype", list(tokens)) if tokens else known
    known = known.select("recording", S.genotype_group("genotype").alias("grp"), "sequence").withColumn("is_control", S.is_control_group("grp"))
    points = points.join(known.select("recording"), "recording", "left_semi")
    points = filters.at_most_tracks(points, most_tracks) if most_tracks else points
    kin = track_kinematics(points, nodes, fps, window, order, centroid, px_per_mm)
    timed = kin.select("recording", "track", "frame", "time", "dt", *METRICS).join(known, "recording")
    return joins.labelled_times(timed, pulses.withColumnRenamed("seq", "sequence"), ["sequence"])


def directional_velocity(lab: DataFrame, pulses: DataFrame, n: int = 1000, pre: float = 10.0, post: float = 70.0, bin_s: float = 0.25, seed: int = 0, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables (by name; None: all nine) of labelled frames in two scopes: all flies up to SHARED_END, and those of the long protocol.

    The scope is a column: a frame stands once in each scope it is in, so every
    table is one aggregation for both, and tests are keyed by it. Write `lab`
    first (io.written) if several of the tables are wanted; tests write their
    units, a row a fly, as they go through them several times.
    """
    frames = filters.scoped(lab, SHARED_END, F.coalesce(F.col("sequence") == "long", F.lit(False)))
    fly = ["scope", "recording", "grp", "is_control", "track"]
    named = lambda df: df.withColumn("fly", F.concat_ws("/", "recording", "track"))
    means = [F.avg(c).alias(c) for c in METRICS]
    over = ["scope", "metric"]

    def stacked(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, ...]], names: list[str]) -> DataFrame:
        """One row a metric, with its columns under common names."""
        each = [F.struct(F.lit(k).alias("metric"), *[F.col(c).alias(name) for c, name in zip(cs, names, strict=True)]) for k, cs in columns.items()]
        return named(df).select(*keys, "fly", F.explode(F.array(*each)).alias("m")).select(*keys, "fly", "m.*")

    def around() -> DataFrame:
        """Frames around onsets; those of the short protocol in the shared scope."""
        seen = frames.where(F.col("speed").isNotNull()).drop("on_index", "stim_on").withColumn("seq", F.when(F.col("scope") == "shared", "short").otherwise("long"))
        return joins.onset_windows(seen, pulses, pre, post, ["seq"]).withColumn("rb", F.floor(F.col("rel") / bin_s) * bin_s)

    def against_control(df: DataFrame, keys: list[str]) -> DataFrame:
        arms = joins.with_pooled_control(io.written(df, "units"), "grp", "is_control")
        return stats.permutation_test(arms, ["scope", "metric", "test", *keys], "fly", "value", "arm", n, "mean", seed)

    starred = lambda df: stats.bh_adjust(io.written(df, "tests"), over=over).withColumn("stars", S.stars("p_adj"))
    per_fly = lambda: stim.per_fly(frames, fly)
    on_off = lambda: stim.on_off(frames, fly, {"speed": "speed", "forward": "forward_velocity"})
    per_stim = lambda: stim.path_integrals(frames, fly)
    control = ["scope", "grp", "is_control"]
    makers = {
        "per_fly": per_fly,
        "on_off": on_off,
        "psth": lambda: around().groupBy(*fly, "rb").agg(*means),
        "psth_per_pulse": lambda: around().groupBy(*fly, "on_index", "rb").agg(*means).groupBy("scope", "grp", "on_index", "rb").agg(*means),
        "per_pulse": lambda: stim.per_pulse(frames, fly, list(METRICS)),
        "per_stim": per_stim,
        "summary_tests": lambda: starred(against_control(stacked(per_fly(), control, {k: (c,) for k, c in METRICS.items()}, ["value"]), [])),
        "on_off_tests": lambda: starred(stats.paired_test(io.written(stacked(on_off(), ["scope", "grp"], {k: (f"{k}_on", f"{k}_off") for k in ("speed", "forward")}, ["on", "off"]), "pairs"), ["scope", "metric", "grp"], "fly", "on", "off", n, "mean", seed)),
        "per_stim_tests": lambda: starred(against_control(stacked(per_stim(), [*control, "on_index"], {k: (k,) for k in ("back_dist", "net_forward")}, ["value"]), ["on_index"]).where("n_a >= 3 AND n_b >= 3")),
    }
    return {k: makers[k]() for k in tables or makers}


def binned_group_test(frames: DataFrame, time: str, value: str, group: str, subject: str, control: str, bins: int, n: int) -> DataFrame:
    binned = A.binned_means(frames, time, value, group, subject, bins)
    return stats.binned_test(binned, "time_bin", subject, f"avg_{value}", group, control, n)


def behaviour_map(rows: DataFrame, features: list[str], k: int, by: str) -> DataFrame:
    """Share of each behaviour cluster within `by`: features to components to clusters to proportions."""
    scores, _ = learn.principal_components(rows, features, 0.95)
    return A.shares(learn.clusters(scores, "scores", k), [by], "cluster")


def behaviour_over_time(rows: DataFrame, cluster: str, kind: str, subject: str, bin_: str, displacement: str, n: int = 1000, seed: int = 0, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """How often each behaviour cluster occurs over time bins, and how efficient it is: tables by name (None: all).

    shares: by kind and bin; subject_shares: by subject too, 0 where a cluster is
    absent from a cell; intervals: their means over subjects with bootstrap
    limits; ranks: clusters by median displacement; efficient: percentage of
    rows in clusters at or above the median of the ranks; weighted and
    weighted_intervals: the mean of the clusters' medians, by subject and over subjects.
    """
    keys = [kind, bin_]

    def per_subject() -> DataFrame:
        cells = rows.select(kind, subject, bin_).dropna().distinct()
        grid = cells.crossJoin(rows.select(cluster).dropna().distinct())  # cells x clusters is the result
        return A.grid_shares(grid, A.counts(rows, [kind, subject, bin_, cluster]), [kind, subject, bin_], cluster)

    ranks = lambda: A.ranked_medians(rows, cluster, displacement)
    scores = lambda: ranks().select(cluster, F.col("median").alias("score"))
    weighted = lambda: A.weighted_score(rows, scores(), cluster, [kind, subject, bin_])
    makers = {
        "shares": lambda: A.shares(rows, keys, cluster),
        "subject_shares": per_subject,
        "intervals": lambda: stats.bootstrap_ci(per_subject(), [*keys, cluster], subject, "share", n, seed=seed),
        "ranks": ranks,
        "efficient": lambda: A.efficient_share(rows, scores(), cluster, bin_),
        "weighted": weighted,
        "weighted_intervals": lambda: stats.bootstrap_ci(weighted(), keys, subject, "weighted", n, seed=seed),
    }
    return {k: makers[k]() for k in tables or makers}


def fly_recording(frames: DataFrame, folder: str, light: list[tuple[str, int]], fps: float) -> DataFrame:
    """Metadata, speed, running distance and light state of every frame."""
    keys = ["recording", "track"]
    out = stim.light_states(stim.sg_speed(frames, keys, "frame", fps), light, keys, "frame")
    w = Window.partitionBy(*keys).orderBy("frame")
    return out.withColumns({"metadata": S.fly_metadata(folder), "cumulated": W.running_total(F.col("speed"), w)})


def name_harmonise(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """Resolved, plain names with their collisions (rank 1 keeps the name)."""
    done = naming.resolve(names, "id", "name", mapping).withColumn("plain", S.plain_name("resolved"))
    return naming.collisions(done, "plain", "id")


def inventory_audit(files: DataFrame, folder: str, kinds: dict[str, str]) -> DataFrame:
    """Coverage of a data tree: counts, sizes, and which folders lack what."""
    counts = A.file_audit(files, folder, F.col("path").rlike(list(kinds.values())[0]), F.col("path").rlike(list(kinds.values())[-1]))
    return counts.join(joins.missing_artifacts(files, folder, kinds), folder)


def instance_pruning(points: DataFrame, node: str, least_score: float, gap: float, controls) -> DataFrame:
    """Score filter, then the two best instances a frame by side; control recordings keep one."""
    rows = points.where((F.col("node") == node) & F.col("x").isNotNull() & (F.col("score") >= least_score)).select("recording", "frame", F.col("track").alias("instance"), "x", "score")
    keys = ["recording", "frame"]
    two = tracks.two_best(rows.where(~controls), keys, gap)
    return two.unionByName(tracks.two_best(rows.where(controls), keys, gap, most=1))

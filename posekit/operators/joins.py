"""Joins: tracks, sizes, intervals, membership, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A small interval table has this many rows at most.
SMALL_INTERVALS = 1_000


def side_by_side(a: DataFrame, b: DataFrame, on: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join of two tables of one shape; other columns get a suffix."""
    rename = lambda df, s: df.select(*on, *[F.col(c).alias(c + s) for c in df.columns if c not in on])
    return rename(a, suffixes[0]).join(rename(b, suffixes[1]), on)


def with_group_size(df: DataFrame, group: list[str], metric: str, out: str = "n") -> DataFrame:
    """Rows with the metric in their group; 0 for a missing group."""
    n = F.count(metric).over(Window.partitionBy(*group))
    known = F.lit(True)
    for g in group:
        known = known & F.col(g).isNotNull()
    return df.withColumn(out, F.when(known, n).otherwise(F.lit(0)))


def proportions(counts: DataFrame, totals: DataFrame, on: list[str], count: str = "count", total: str = "total") -> DataFrame:
    """count / total, totals from a population of their own; 0/0 and missing totals are null."""
    return counts.join(totals, on, "left").withColumn("proportion", F.try_divide(F.col(count).cast("double"), F.col(total)))


def in_intervals(df: DataFrame, intervals: DataFrame, time: str = "time", keys: list[str] = (), how: str = "left", before: float = 0.0, after: float | None = None, bucket: float = 60.0, small: bool = True) -> DataFrame:
    """Rows in intervals [start_s - before, end_s), or [start_s - before, start_s + after); all matches.

    A small interval table (a protocol, of SMALL_INTERVALS rows at most) is
    broadcast; any other is cut to time buckets, which make the range join an
    equi join.
    """
    lo, hi = F.col("start_s") - before, (F.col("end_s") if after is None else F.col("start_s") + after)
    iv = intervals.withColumns({"_lo": lo, "_hi": hi})
    on = lambda left, right: [left[k] == right[k] for k in keys] + [left[time] >= right["_lo"], left[time] < right["_hi"]]
    if small:
        few = F.when(F.count("*").over(Window.partitionBy(F.lit(0))) > SMALL_INTERVALS, F.raise_error(F.lit(f"more than {SMALL_INTERVALS} intervals: pass small=False"))).otherwise(F.lit(True))
        right = F.broadcast(iv.withColumn("_few", few).where("_few").drop("_few"))
        out = df.join(right, on(df, right), how)
    else:
        left = df.withColumn("_b", F.floor(F.col(time) / bucket))
        right = iv.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / bucket), F.floor(F.col("_hi") / bucket))))
        out = left.join(right, [*on(left, right), left["_b"] == right["_b"]], how)
        out = out.drop(left["_b"]).drop(right["_b"])
    for k in keys:
        out = out.drop(iv[k])
    return out.drop("_lo", "_hi")


def labelled_times(df: DataFrame, pulses: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Adds stim_on and on_index (null when off)."""
    out = in_intervals(df, pulses, keys=list(keys))
    return out.withColumn("stim_on", F.col("on_index").isNotNull()).drop("start_s", "end_s")


def onset_windows(df: DataFrame, pulses: DataFrame, pre: float, post: float, keys: list[str] = ()) -> DataFrame:
    """Rows within [onset - pre, onset + post) of every pulse (of the same keys), repeated for each, with time since the onset."""
    out = in_intervals(df, pulses, keys=list(keys), how="inner", before=pre, after=post)
    return out.withColumn("rel", F.col("time") - F.col("start_s")).drop("end_s")


def track_pairs(centroids: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair of tracks in a frame, the lower-ranked one (larger rank) as a."""
    a = centroids.select(*keys, F.col("track").alias("a"), F.col("rank").alias("ra"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    b = centroids.select(*keys, F.col("track").alias("b"), F.col("rank").alias("rb"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    return a.join(b, keys).where(F.col("ra") > F.col("rb"))


def segments(points: DataFrame, edges: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Both ends of every skeleton edge in a frame, if both were seen, and its length.

    A frame's nodes meet in one aggregation; the edges are laid out from its row, without a join.
    """
    nodes = list(dict.fromkeys(n for e in edges for n in e))
    seen = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    wide = seen.groupBy(*keys).agg(*[F.max(F.when(F.col("node") == n, F.struct("x", "y"))).alias(f"_{k}") for k, n in enumerate(nodes)])
    at = {n: F.col(f"_{k}") for k, n in enumerate(nodes)}
    ends = F.array(*[F.when(at[a].isNotNull() & at[b].isNotNull(), F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), at[a].alias("p"), at[b].alias("q"))) for a, b in edges])
    rows = wide.select(*keys, F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("e"))
    rows = rows.select(*keys, "e.src", "e.dst", F.col("e.p.x").alias("x_src"), F.col("e.p.y").alias("y_src"), F.col("e.q.x").alias("x_dst"), F.col("e.q.y").alias("y_dst"))
    return rows.withColumn("length", F.hypot(F.col("x_dst") - F.col("x_src"), F.col("y_dst") - F.col("y_src")))


def in_cluster(events: DataFrame, clustered: DataFrame, keys: list[str], cluster: int) -> DataFrame:
    return events.join(clustered.where(F.col("cluster") == cluster).select(*keys), keys, "left_semi")


def event_metadata(rows: DataFrame, keys: list[str], path: str, displacement: DataFrame) -> DataFrame:
    """Per event: its path, first and last frame, and its displacement where known."""
    paths = rows.select(*keys, path).dropDuplicates(keys)
    spans = rows.groupBy(*keys).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    return paths.join(spans, keys).join(displacement, keys, "left")


def missing_artifacts(files: DataFrame, folder: str, kinds: dict[str, str]) -> DataFrame:
    """Per folder, whether it holds a file of each kind (by pattern)."""
    return files.groupBy(folder).agg(*[F.bool_or(F.col("path").rlike(p)).alias(f"has_{k}") for k, p in kinds.items()])


def upload_plan(files: DataFrame, remote: DataFrame, limit: int) -> DataFrame:
    """new / existing / oversize for every file."""
    there = remote.select("name").distinct().withColumn("_there", F.lit(True))
    state = F.when(F.col("size") > limit, "oversize").when(F.col("_there"), "existing").otherwise("new")
    return files.join(there, "name", "left").withColumn("state", state).drop("_there")


def with_pooled_control(units: DataFrame, group: str, is_control: str) -> DataFrame:
    """Rows of every experimental group, and the control's rows once for each of them, as (test, arm)."""
    cases = units.where(~F.col(is_control)).withColumn("test", F.col(group)).withColumn("arm", F.lit("a"))
    tests = cases.select("test").distinct()
    controls = units.where(F.col(is_control)).crossJoin(tests).withColumn("arm", F.lit("b"))  # the product is the result: controls x tests
    return cases.unionByName(controls)


def companions(folders: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """Per folder and wanted file name: whether it is there."""
    wanted = folders.select("folder").distinct().select("folder", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    have = files.select("folder", "name").distinct().withColumn("found", F.lit(True))
    return wanted.join(have, ["folder", "name"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def matches_by_stem(recordings: DataFrame, files: DataFrame, size: int = 5) -> DataFrame:
    """Per recording, the number of files whose name contains its stem (not empty).

    An index lists the names of every part of `size` characters. A stem is looked
    up by the rarest of its parts, and the names found there are compared with it;
    a stem one of whose parts no name has is in no name. The number of names of a
    stem of `size` characters or fewer is that of the part itself, so no name is
    compared with it.
    """
    stems = recordings.select("stem").where(F.length("stem") > 0).distinct()
    names = files.select("name").groupBy("name").agg(F.count("*").alias("_n"))
    parts = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    each = lambda df, c, sizes: df.withColumn("_part", F.explode(F.array_distinct(F.concat(*[parts(c, n) for n in sizes]))))
    few = each(names, "name", range(1, size + 1)).groupBy(F.col("_part").alias("stem")).agg(F.sum("_n").alias("n"))
    short = stems.where(F.length("stem") <= size).join(few, "stem")
    listed = each(names, "name", [size])
    known = listed.groupBy("_part").agg(F.count("*").alias("_names"))
    wanted = each(stems.where(F.length("stem") > size), "stem", [size]).join(known, "_part", "left")
    rarest = wanted.groupBy("stem").agg(F.min_by("_part", F.struct("_names", "_part")).alias("_part"), F.count_if(F.col("_names").isNull()).alias("_gone")).where("_gone = 0")
    long = rarest.join(listed, "_part").where(F.contains("name", "stem")).groupBy("stem").agg(F.sum("_n").alias("n"))
    hits = short.select("stem", "n").union(long)
    return recordings.select("stem").distinct().join(hits, "stem", "left").select("stem", F.coalesce("n", F.lit(0)).alias("n"))

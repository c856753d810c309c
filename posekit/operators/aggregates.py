"""Grouped summaries, proportions, histograms, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posekit.functions import windows as W
from posekit.operators.ranks import quantiles


def not_null(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def binned_means(df: DataFrame, time: str, value: str, group: str, subject: str, bins: int | list[float] | None) -> DataFrame:
    """avg_<value> and median_<value> by (time_bin, group, subject); missing keys are dropped; bins None keeps the time."""
    if bins is None:
        df = df.withColumn("time_bin", F.col(time))
    elif isinstance(bins, int):
        df = W.equal_bins(df, time, bins, "time_bin")
    else:
        df = df.withColumn("time_bin", W.edge_bins(F.col(time), bins))
    keys = ["time_bin", group, subject]
    return not_null(df, keys).groupBy(*keys).agg(F.avg(value).alias(f"avg_{value}"), F.percentile(value, F.lit(0.5)).alias(f"median_{value}"))


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return not_null(df, keys).groupBy(*keys).agg(F.count("*").alias("count"))


def shares(df: DataFrame, within: list[str], value: str, least: int = 0) -> DataFrame:
    """Share of each value within a group; missing values are not counted; groups of fewer than `least` rows are left out."""
    total = F.sum("count").over(Window.partitionBy(*within))
    out = counts(df, [*within, value]).withColumn("total", total).withColumn("share", F.col("count") / F.col("total"))
    return out.where(F.col("total") >= least)


def grid_shares(grid: DataFrame, counted: DataFrame, within: list[str], value: str) -> DataFrame:
    """Share of each value within a cell on the complete grid: 0 where absent, null where the cell has nothing."""
    keys = [*within, value]
    full = grid.join(counted, keys, "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy(*within))
    return full.select(*keys, "count", F.try_divide(F.col("count").cast("double"), total).alias("share"))


def events_per_subject(df: DataFrame, group: str, subject: str, event: str) -> DataFrame:
    """Distinct events of each subject, and the subjects of its group."""
    own = df.groupBy(group, subject).agg(F.count_distinct(event).alias("n_events"))
    return own.withColumn("n_subjects", F.count("*").over(Window.partitionBy(group)))


def cardinalities(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns], F.count("*").alias("n"))


def mean_ci(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, n, std and half-width 1.96 std / sqrt(n)."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_samp(value).alias("std"))
    return out.withColumn("ci", 1.96 * F.col("std") / F.sqrt("n"))


def ranked_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups by falling median of positive values."""
    out = quantiles(df.where(F.col(value) > 0), [group], value, [0.5]).select(group, F.col("q")[0].alias("median"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("median"), group)))


def efficient_share(df: DataFrame, scores: DataFrame, cluster: str, bin_: str) -> DataFrame:
    """Per bin, the percentage of rows in clusters at or above the median score."""
    middle = scores.agg(F.percentile("score", F.lit(0.5)).alias("_mid"))
    flagged = scores.join(F.broadcast(middle)).select(cluster, (F.col("score") >= F.col("_mid")).alias("efficient"))
    return df.join(flagged, cluster).groupBy(bin_).agg((F.avg(F.col("efficient").cast("double")) * 100).alias("efficient"), (F.avg((~F.col("efficient")).cast("double")) * 100).alias("inefficient"))


def weighted_score(df: DataFrame, scores: DataFrame, cluster: str, keys: list[str]) -> DataFrame:
    """Mean score of a bin's rows; rows of clusters without a score add 0 but count."""
    n = counts(df, [*keys, cluster]).join(scores, cluster, "left")
    return n.groupBy(*keys).agg((F.sum(F.col("count") * F.coalesce("score", F.lit(0.0))) / F.sum("count")).alias("weighted"))


def spans(df: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"))


def crop_box(df: DataFrame, keys: list[str], xs: list[str], ys: list[str], width: int, height: int, margin: int = 15) -> DataFrame:
    """Box around point sets with a margin, inside the frame, halves to even."""
    lo = lambda cs: F.least(*[F.min(c) for c in cs]) if len(cs) > 1 else F.min(cs[0])
    hi = lambda cs: F.greatest(*[F.max(c) for c in cs]) if len(cs) > 1 else F.max(cs[0])
    return df.groupBy(*keys).agg(
        F.greatest(F.lit(0), F.bround(lo(xs) - margin).cast("int")).alias("x_min"),
        F.least(F.lit(width), F.bround(hi(xs) + margin).cast("int")).alias("x_max"),
        F.greatest(F.lit(0), F.bround(lo(ys) - margin).cast("int")).alias("y_min"),
        F.least(F.lit(height), F.bround(hi(ys) + margin).cast("int")).alias("y_max"),
    )


def inactive(df: DataFrame, keys: list[str], skip: int, limit: float = 20.0) -> DataFrame:
    """Whether y stays within a limit of its first value after the first rows."""
    w = Window.partitionBy(*keys).orderBy("frame")
    late = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > skip)
    first = late.groupBy(*keys).agg(F.min_by("y", F.when(F.col("y").isNotNull(), F.col("frame"))).alias("y0"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    return first.select(*keys, (F.greatest(F.col("hi") - F.col("y0"), F.col("y0") - F.col("lo")) <= limit).alias("inactive"))


def constant_metadata(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per group, `name: value` of the columns that have one value there, joined by ` | `."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.concat(F.lit(f"{c}: "), F.max(F.col(c).cast("string"))))
    return df.groupBy(group).agg(F.concat_ws(" | ", *[one(c) for c in columns]).alias("metadata"))


def histogram(df: DataFrame, group: str, value: str) -> DataFrame:
    """Counts in Freedman-Diaconis bins of each group, the last bin closed; no spread means one bin."""
    stat = quantiles(df, [group], value, [0.0, 0.25, 0.75, 1.0]).select(group, "n", F.slice("q", 2, 2).alias("q"), F.col("q")[0].alias("lo"), F.col("q")[3].alias("hi"))
    h = 2 * (F.col("q")[1] - F.col("q")[0]) / F.cbrt("n")
    stat = stat.withColumn("bins", F.greatest(F.lit(1), F.coalesce(F.ceil(F.try_divide(F.col("hi") - F.col("lo"), h)), F.lit(1))).cast("int"))
    rows = df.where(F.col(value).isNotNull()).join(stat, group)
    at = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")) * F.col("bins")), F.lit(0))
    return rows.withColumn("bin", F.least(at, F.col("bins") - 1).cast("int")).groupBy(group, "bin").agg(F.count("*").alias("count"))


def joint_counts(df: DataFrame, x: str, y: str, bins: tuple[int, int]) -> DataFrame:
    """Counts in two-dimensional bins, with the marginals (null bin on one side) from the same pass."""
    limits = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cut = lambda c, lo, hi, n: F.least(F.floor(F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)) * n), F.lit(n - 1)).cast("int")
    rows = df.dropna(subset=[x, y]).join(F.broadcast(limits)).select(cut(x, "x0", "x1", bins[0]).alias("bx"), cut(y, "y0", "y1", bins[1]).alias("by"))
    out = rows.cube("bx", "by").agg(F.count("*").alias("count"), F.grouping_id().alias("g"))
    return out.where("g < 3").drop("g")


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers inside 1.5 IQR, 0.95 quantile, extremes."""
    names = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "q95": 0.95, "max": 1.0}
    q = quantiles(df, [group], value, list(names.values())).select(group, *[F.col("q")[k].alias(n) for k, n in enumerate(names)])
    iqr = F.col("q3") - F.col("q1")
    inside = df.join(q, group).where(F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr))
    return q.join(inside.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high")), group)


def control_band(df: DataFrame, value: str, control: str) -> DataFrame:
    """Quartile band of the control rows."""
    return quantiles(df.where(F.col(control)), [], value, [0.25, 0.75]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def file_audit(files: DataFrame, folder: str, processed: Column, match: Column) -> DataFrame:
    """Counts, processed / rest (0 without rest), size, and whether several files match."""
    n, done = F.count("*"), F.count_if(processed)
    return files.groupBy(folder).agg(n.alias("n"), done.alias("n_processed"), F.when(n > done, done / (n - done)).otherwise(F.lit(0.0)).alias("ratio"), (F.count_if(match) > 1).alias("several"), F.sum("size").alias("size"))


def compared(results: DataFrame, name: str, baseline: str, size: str, seconds: str) -> DataFrame:
    """Size in % of the baseline's, savings, and whether a row is best by size or by time."""
    base = results.where(F.col(name) == baseline).agg(F.max(size).alias("_base"))
    best = results.agg(F.min_by(name, F.struct(size, name)).alias("_s"), F.min_by(name, F.struct(seconds, name)).alias("_t"))
    out = results.join(F.broadcast(base)).join(F.broadcast(best))
    pct = F.col(size) / F.col("_base") * 100
    return out.select(*results.columns, pct.alias("percent"), (100 - pct).alias("savings"), (F.col(name) == F.col("_s")).alias("best_size"), (F.col(name) == F.col("_t")).alias("best_time"))

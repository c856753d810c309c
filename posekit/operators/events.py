"""Events in signals: runs, gaps, contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posekit.functions.windows import PAST


def runs(df: DataFrame, keys: list[str], order_by: str, inside: Column, least: int) -> DataFrame:
    """Start and end of runs of rows for which `inside` holds, of at least so many frames from end to end."""
    w = Window.partitionBy(*keys).orderBy(order_by)
    flag = F.coalesce(inside, F.lit(False))
    change = (flag != F.lag(flag, 1, False).over(w)).cast("int")
    blocks = df.withColumns({"_f": flag, "_c": change}).withColumn("_b", F.sum("_c").over(w.rowsBetween(*PAST))).where("_f")
    out = blocks.groupBy(*keys, "_b").agg(F.min(order_by).alias("start"), F.max(order_by).alias("end"))
    return out.where(F.col("end") - F.col("start") >= least).drop("_b")


def find_events(df: DataFrame, keys: list[str], order_by: str, signal: str, limits: tuple[float, float], gap: int, least: int, omit: tuple[int, int] | None = None, share: float = 0.75) -> DataFrame:
    """Events of samples inside open limits.

    A gap of more than `gap` samples starts a new event; events of one sample
    go. An event that starts in the omitted range is cut to its end, or goes if
    it ends in it. Kept are events longer than `least` with more than `share` of
    [start, end) inside the limits. Sample numbers count from 0.
    """
    w = Window.partitionBy(*keys).orderBy("_i")
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order_by)) - 1)
    hits = rows.where((F.col(signal) > limits[0]) & (F.col(signal) < limits[1])).select(*keys, "_i")
    new = F.coalesce((F.col("_i") - F.lag("_i").over(w) > gap).cast("int"), F.lit(0))
    grouped = hits.withColumn("_new", new).withColumn("_e", F.sum("_new").over(w.rowsBetween(*PAST)))
    # Hits are counted from the (possibly cut) start and before the end, so the end sample is left out.
    span = Window.partitionBy(*keys, "_e")
    grouped = grouped.withColumns({"_s": F.min("_i").over(span), "_t": F.max("_i").over(span), "_n": F.count("*").over(span)}).where("_n >= 2")
    start = F.col("_s")
    if omit:
        within = (F.col("_s") >= omit[0]) & (F.col("_s") < omit[1])
        grouped = grouped.where(~(within & (F.col("_t") < omit[1])))
        start = F.when(within & (F.col("_t") > omit[1]), F.lit(omit[1])).otherwise(F.col("_s"))
    events = grouped.withColumn("start", start).groupBy(*keys, "start", F.col("_t").alias("end")).agg(F.count_if((F.col("_i") >= F.col("start")) & (F.col("_i") < F.col("_t"))).alias("_hits"))
    duration = F.col("end") - F.col("start")
    return events.withColumn("duration", duration).where((duration > least) & (F.col("_hits") > share * duration)).drop("_hits")


def contact_onsets(df: DataFrame, keys: list[str], order_by: str, distance: str, limit: float, gap: int = 29) -> DataFrame:
    """Rows with this and the next distance below a limit, more than `gap` frames after the previous such row."""
    w = Window.partitionBy(*keys).orderBy(order_by)
    close = df.withColumn("_next", F.lead(distance).over(w)).where((F.col(distance) < limit) & (F.col("_next") < limit))
    return close.withColumn("_gap", F.col(order_by) - F.lag(order_by).over(w)).where(F.col("_gap") > gap).drop("_next", "_gap")

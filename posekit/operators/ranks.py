"""Ranks, running totals and exact quantiles of whole tables, without a task that holds a whole group.

Values are dealt to buckets in their own order. Totals of the buckets, one row
each, give every bucket its offset; inside a bucket a window does the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, Window.currentRow)
ONWARD = (Window.currentRow, Window.unboundedFollowing)
AFTER = (1, Window.unboundedFollowing)
#: Buckets of an octave of positive numbers: at most so many times the 2,100 exponents that doubles have.
PER_OCTAVE = 64
#: Hexadecimal digits of a unit's hash that name its bucket: 4,096 buckets a group.
DIGITS = 3


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which missing keys meet missing keys; the right side's keys are dropped."""
    if not keys:
        return left.join(F.broadcast(right), how=how)  # right is one row
    names = {k: f"_r{n}" for n, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    on = reduce(Column.__and__, [left[k].eqNullSafe(right[r]) for k, r in names.items()])
    return left.join(right, on, how).drop(*names.values())


def octaves(x: Column) -> Column:
    """Buckets of numbers from 0, in their order."""
    return F.when(x > 0, F.floor(F.log2(x) * PER_OCTAVE).cast("int")).otherwise(-PER_OCTAVE * 1100)


def running(df: DataFrame, over: list[str], bucket: str, order: list[str], n: str, out: str, total: str) -> DataFrame:
    """df with the running total of n in the order of (bucket, order) within `over`, and the whole total."""
    sums = df.groupBy(*over, bucket).agg(F.sum(n).alias("_t"))
    w = Window.partitionBy(*over).orderBy(bucket)  # one row a bucket
    base = sums.withColumns({"_base": F.coalesce(F.sum("_t").over(w.rowsBetween(*BEFORE)), F.lit(0)), total: F.sum("_t").over(Window.partitionBy(*over))}).drop("_t")
    inside = F.sum(n).over(Window.partitionBy(*over, bucket).orderBy(*order).rowsBetween(*UPTO))
    return joined(df, base, [*over, bucket]).withColumn(out, F.col("_base") + inside).drop("_base")


def least_onward(df: DataFrame, over: list[str], bucket: str, order: list[str], x: str, out: str) -> DataFrame:
    """df with the least x of the row and all after it in the order of (bucket, order) within `over`."""
    mins = df.groupBy(*over, bucket).agg(F.min(x).alias("_t"))
    w = Window.partitionBy(*over).orderBy(bucket)  # one row a bucket
    later = mins.withColumn("_later", F.min("_t").over(w.rowsBetween(*AFTER))).drop("_t")
    inside = F.min(x).over(Window.partitionBy(*over, bucket).orderBy(*order).rowsBetween(*ONWARD))
    return joined(df, later, [*over, bucket]).withColumn(out, F.least(inside, "_later")).drop("_later")


def bh_adjust(df: DataFrame, p: str = "p", out: str = "p_adj", over: list[str] = ()) -> DataFrame:
    """Benjamini-Hochberg: p * m / rank, monotone, at most 1, within `over`; nulls pass through.

    Tests of equal p have one adjusted value, so distinct p are ranked, each
    with its number of tests. A window over a whole table sees one row a bucket.
    """
    over = list(over)
    each = df.where(F.col(p).isNotNull()).groupBy(*over, p).agg(F.count("*").alias("_n")).withColumn("_b", octaves(F.col(p)))
    ranked = running(each, over, "_b", [p], "_n", "_rank", "_m").withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    least = least_onward(ranked, over, "_b", [p], "_q", "_least").select(*over, p, F.least("_least", F.lit(1.0)).alias(out))
    names = {k: f"_r{n}" for n, k in enumerate([*over, p])}
    least = least.withColumnsRenamed(names)
    on = reduce(Column.__and__, [df[k].eqNullSafe(least[r]) for k, r in names.items()])
    return df.join(least, on, "left").drop(*names.values())


def numbered(df: DataFrame, keys: list[str], unit: str, number: str = "_pos", total: str = "_n") -> DataFrame:
    """Rows (one a unit) numbered from 0 within their group, in the order of a hash of the unit; and the group's rows.

    The hash spreads a group over 4,096 buckets, so a group of any size is
    numbered by many tasks, and its numbers do not depend on how it was dealt.
    """
    h = F.md5(F.col(unit).cast("string"))
    rows = df.withColumns({"_h": h, "_b": F.substring(h, 1, DIGITS), "_one": F.lit(1)})
    out = running(rows, keys, "_b", ["_h", unit], "_one", number, total)
    return out.withColumn(number, F.col(number) - 1).drop("_h", "_b", "_one")


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], out: str = "q", accuracy: int = 10_000) -> DataFrame:
    """(keys, n, out): exact interpolated quantiles of each group's values, as an array in the order of qs.

    One pass finds, by mergeable summaries of bounded size, two values around
    each quantile whose ranks are at most a few n / accuracy apart. A second
    pass counts what lies below and keeps only the values in between, counted
    by value. The wanted ranks are looked up there; if the summaries were wrong
    about them, this is an error and no wrong value.
    """
    ks = [f"_k{n}" for n in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)], F.col(value).cast("double").alias("_v"))
    pad = 2.0 / accuracy
    ends = [min(max(q + d, 0.0), 1.0) for q in qs for d in (-pad, pad)]
    edges = rows.groupBy(*ks).agg(F.percentile_approx("_v", ends, accuracy).alias("_e"), F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    few = F.col("n") <= 2 * accuracy  # as many values as a summary may hold: all are looked at
    low = [F.col("_lo") if q - pad <= 0 else F.when(few, F.col("_lo")).otherwise(F.col("_e")[2 * i]) for i, q in enumerate(qs)]
    high = [F.col("_hi") if q + pad >= 1 else F.when(few, F.col("_hi")).otherwise(F.col("_e")[2 * i + 1]) for i, q in enumerate(qs)]
    edges = edges.select(*ks, "n", *[a.alias(f"_a{i}") for i, a in enumerate(low)], *[b.alias(f"_z{i}") for i, b in enumerate(high)])
    v, slots = F.col("_v"), range(len(qs))
    below = sum((F.when(v < F.col(f"_a{i}"), 1 << i).otherwise(0) for i in slots), F.lit(0))
    inside = reduce(Column.__or__, [v.between(F.col(f"_a{i}"), F.col(f"_z{i}")) for i in slots])
    cells = joined(rows, edges, ks).groupBy(*ks, below.alias("_below"), F.when(inside, v).alias("_v")).agg(F.count("*").alias("_c"))
    # From here on there are few rows: one a value in between, and a few counts.
    cells = joined(cells, edges, ks)
    each = cells.select(*ks, "n", "_below", "_v", "_c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_a{i}").alias("a"), F.col(f"_z{i}").alias("z"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(qs)])).alias("s"))
    under = F.sum(F.when(F.col("_below").bitwiseAND(F.expr("shiftleft(1, s.i)")) > 0, F.col("_c")).otherwise(0))
    start = each.groupBy(*ks, "s.i").agg(under.alias("_under"))
    near = each.where(F.col("_v").between(F.col("s.a"), F.col("s.z"))).select(*ks, "n", "s.i", "s.at", "_v", "_c")
    w = Window.partitionBy(*ks, "i").orderBy("_v").rowsBetween(*UPTO)
    near = joined(near.withColumn("_upto", F.sum("_c").over(w)), start, [*ks, "i"])
    last = F.col("_under") + F.col("_upto")  # ranks from 0 of a value: last - _c to last - 1
    at = lambda r: F.max(F.when((r >= last - F.col("_c")) & (r < last), F.col("_v")))
    found = near.groupBy(*ks, "n", "i", "at").agg(at(F.floor("at")).alias("x"), at(F.ceil("at")).alias("y"))
    value_at = F.coalesce(F.col("x") + (F.col("y") - F.col("x")) * (F.col("at") - F.floor("at")), F.raise_error(F.lit("a quantile lies outside its summary's bounds")).cast("double"))
    exact = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(value_at)
    done = found.groupBy(*ks, "n").agg(F.array_sort(F.collect_list(F.struct("i", exact.alias("q")))).alias("_q"))
    return done.select(*[F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)], "n", F.transform("_q", lambda s: s["q"]).alias(out))

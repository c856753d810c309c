"""Resampling statistics on portable draws.

A draw is md5 of seed, test, repetition and unit, so every engine draws alike.
Data are first reduced to subjects; repetitions multiply subjects only, and the
shuffle key is (test, repetition), which spreads a large test by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posekit.operators.ranks import bh_adjust, joined, numbered
from posekit.sources.io import written

STATISTICS: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}


def statistic_of(name: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """An aggregate by name, or a function Column -> aggregate Column."""
    if callable(name):
        return name
    if name not in STATISTICS:
        raise ValueError(f"statistic must be one of {sorted(STATISTICS)}, not {name!r}")
    return STATISTICS[name]


def draw_text(seed: int, *parts: str | Column) -> Column:
    """32 random bits as eight hexadecimal digits, which sort as their number does."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 8)


def draw(seed: int, *parts: str | Column) -> Column:
    """32 random bits as a long."""
    return F.conv(draw_text(seed, *parts), 16, 10).cast("long")


def repeated(df: DataFrame, n: int) -> DataFrame:
    """Rows times repetitions, made by all shuffle partitions; as Spark plans with the size before, joins of the result need a hint."""
    return spread(df).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows over all shuffle partitions: they are few and small, and what is made of each is not."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def bootstrap_reps(df: DataFrame, keys: list[str], unit: str, value: str, n: int, statistic="mean", seed: int = 0) -> DataFrame:
    """(keys, rep, stat): statistic of n resamples of each group's values."""
    df = df.where(F.col(value).isNotNull())
    placed = numbered(df.select(*keys, unit, F.col(value).alias("_v")), keys, unit).drop(unit)
    test = [F.col(k).cast("string") for k in keys]
    picks = repeated(placed.select(*keys, F.col("_pos").alias("_slot"), "_n"), n)
    picks = picks.withColumn("_pos", (draw(seed, *test, F.col("rep").cast("string"), F.col("_slot").cast("string")) % F.col("_n")).cast("int"))
    return picks.hint("merge").join(placed.select(*keys, "_pos", "_v"), [*keys, "_pos"]).groupBy(*keys, "rep").agg(statistic_of(statistic)(F.col("_v")).alias("stat"))


def bootstrap_ci(df: DataFrame, keys: list[str], unit: str, value: str, n: int = 1000, ci: float = 95.0, statistic="mean", seed: int = 0) -> DataFrame:
    """(keys, n, point, lo, hi); groups without values have nulls, single values are their own interval."""
    reps = bootstrap_reps(df, keys, unit, value, n, statistic, seed)
    tail = (100.0 - ci) / 200.0
    band = reps.groupBy(*keys).agg(F.percentile("stat", F.lit(tail)).alias("lo"), F.percentile("stat", F.lit(1.0 - tail)).alias("hi"))
    point = df.groupBy(*keys).agg(F.count(value).alias("n"), statistic_of(statistic)(F.col(value)).alias("point"))
    return point.join(band, keys, "left")


def bootstrap_band(matrix: DataFrame, subject: str, bin_: str, value: str, n: int = 1000, ci: float = 95.0, seed: int = 0) -> DataFrame:
    """(bin, point, lo, hi) of the mean over resampled subjects; a resample takes whole subjects, gaps are left out."""
    matrix = matrix.where(F.col(value).isNotNull())
    placed = numbered(matrix.select(subject).distinct(), [], subject)
    picks = repeated(placed.select(F.col("_pos").alias("_slot"), "_n"), n)
    picks = picks.withColumn("_pos", (draw(seed, F.lit("band"), F.col("rep").cast("string"), F.col("_slot").cast("string")) % F.col("_n")).cast("int"))
    own = matrix.groupBy(subject).agg(F.collect_list(F.struct(bin_, F.col(value).alias("_v"))).alias("_cells"))  # a subject's bins
    own = placed.select("_pos", subject).join(own, subject).select("_pos", "_cells")
    means = picks.select("rep", "_pos").hint("merge").join(own, "_pos").select("rep", F.inline("_cells")).groupBy("rep", bin_).agg(F.avg("_v").alias("m"))
    tail = (100.0 - ci) / 200.0
    band = means.groupBy(bin_).agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1.0 - tail)).alias("hi"))
    return matrix.groupBy(bin_).agg(F.avg(value).alias("point")).join(band, bin_)


#: Units of a test that one task may hold; of larger tests only the units near the arms' border meet.
SMALL_TEST = 20_000
#: Repetitions that one row of a small test stands for; bits of a draw that name its cell.
REP_BLOCK, CELL_BITS = 50, 12


def _small_tests(rows: DataFrame, both: DataFrame, keys: list[str], unit: str, n: int, statistic: str, seed: int) -> DataFrame:
    """(keys, _x): how many repetitions are extreme, a row a block of repetitions. A test's units meet in one row, whose repetitions need no exchange."""
    test = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col("_v").alias("v")))).alias("_units"))
    held = joined(held, both, keys).withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(n), F.lit(REP_BLOCK))))
    flat = held.select(*keys, test.alias("_test"), "_rep", "n_a", "diff", F.transform("_units", lambda x: x["u"].cast("string")).alias("_u"), F.transform("_units", lambda x: x["v"].cast("double")).alias("_w"))
    flat = spread(flat, *keys, "_rep")
    types = dict(flat.dtypes)
    middle = {"mean": np.mean, "median": np.median}[statistic]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for name, first, n_a, diff, units, values in zip(pdf["_test"], pdf["_rep"], pdf["n_a"], pdf["diff"], pdf["_u"], pdf["_w"], strict=True):
                values, extreme = np.asarray(values, float), 0
                for rep in range(first, min(first + REP_BLOCK, n + 1)):
                    draws = [hashlib.md5(f"{name}|{rep}|{u}".encode()).hexdigest()[:8] for u in units]
                    order = np.argsort(np.array(draws), kind="stable")
                    d = middle(values[order[:n_a]]) - middle(values[order[n_a:]])
                    extreme += round(abs(d), 9) >= round(abs(diff), 9)
                found.append(extreme)
            yield pdf[keys].assign(_x=found)

    return flat.mapInPandas(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "_x long"]))


def near_bounds(n_a: Column, size: Column) -> tuple[Column, Column]:
    """Draws (as draw_text gives them) between which the n_a-th smallest of `size` lies, whole cells of CELL_BITS bits.

    By Chernoff's bound it lies outside in less than one of 10^17 repetitions;
    the bounds are about 18 * sqrt(n_a) units apart.
    """
    cells = 1 << CELL_BITS
    under = F.greatest(n_a - F.sqrt(80.0 * n_a), F.lit(0.0)) / size
    upto = (n_a + 40.0 + F.sqrt(80.0 * n_a + 1600.0)) / size
    text = lambda cell: F.lpad(F.lower(F.hex(cell * (1 << (32 - CELL_BITS)))), 8, "0")
    low = text(F.floor(under * cells).cast("long"))
    return low, F.when(upto < 1.0, text(F.least(F.floor(upto * cells).cast("long") + 1, F.lit(cells - 1).cast("long"))))


def _large_means(rows: DataFrame, both: DataFrame, keys: list[str], unit: str, n: int, seed: int) -> DataFrame:
    """(keys, _x) of tests of any size, for means, in one pass over the draws.

    What a repetition surely gives arm a leaves a task as one row, what it
    surely leaves to arm b does not leave it, and only the few units with draws
    near the n_a-th are put in order.
    """
    test = [F.col(k).cast("string") for k in keys]
    size = F.col("n_a") + F.col("n_b")
    low, high = near_bounds(F.col("n_a"), size)
    tests = both.withColumns({"_low": low, "_high": high})  # SMALL_TEST units a row at least
    sums = joined(rows.groupBy(*keys).agg(F.sum("_v").alias("_all")), F.broadcast(tests.select(*keys, "n_a", "n_b", "diff")), keys)
    drawn = repeated(joined(rows, F.broadcast(tests.select(*keys, "_low", "_high")), keys), n)
    drawn = drawn.withColumn("_d", draw_text(seed, *test, F.col("rep").cast("string"), F.col(unit).cast("string")))
    drawn = drawn.where(F.col("_high").isNull() | (F.col("_d") < F.col("_high")))
    near = F.col("_d") >= F.col("_low")
    parts = drawn.groupBy(*keys, "rep", F.when(near, F.col("_d")).alias("_d"), F.when(near, F.col(unit)).alias("_u")).agg(F.count("*").alias("_c"), F.sum("_v").alias("_v"))
    edge = F.array_sort(F.collect_list(F.when(F.col("_d").isNotNull(), F.struct("_d", "_u", "_v", "_c"))))
    sure = lambda c: F.coalesce(F.sum(F.when(F.col("_d").isNull(), F.col(c))), F.lit(0))
    reps = parts.groupBy(*keys, "rep").agg(sure("_c").alias("_under"), sure("_v").alias("_sum"), edge.alias("_edge"))
    reps = joined(reps, F.broadcast(sums), keys)
    left = (F.col("n_a") - F.col("_under")).cast("int")
    rest = F.aggregate(F.slice("_edge", F.lit(1), left), F.lit(0.0), lambda z, x: z + x["_v"])
    inside = left.between(0, F.size("_edge"))
    a = F.when(inside, F.col("_sum") + rest).otherwise(F.raise_error(F.lit("a draw lies outside its bounds")).cast("double"))
    delta = F.col("_a") / F.col("n_a") - (F.col("_all") - F.col("_a")) / F.col("n_b")
    out = reps.withColumn("_a", a).select(*keys, "diff", delta.alias("_delta"))
    return out.groupBy(*keys).agg(F.count_if(F.round(F.abs("_delta"), 9) >= F.round(F.abs("diff"), 9)).alias("_x"))


def _by_windows(rows: DataFrame, both: DataFrame, keys: list[str], unit: str, n: int, stat: Callable[[Column], Column], seed: int) -> DataFrame:
    """(keys, _x) for any statistic: every repetition in the order of its draws."""
    test = [F.col(k).cast("string") for k in keys]
    every = repeated(joined(rows, both.select(*keys, "n_a"), keys), n)
    rank = F.row_number().over(Window.partitionBy(*keys, "rep").orderBy(draw_text(seed, *test, F.col("rep").cast("string"), F.col(unit).cast("string")), unit))
    first = every.withColumn("_first", rank <= F.col("n_a"))
    value_of = lambda flag: stat(F.when(flag, F.col("_v")))
    perm = first.groupBy(*keys, "rep").agg((value_of(F.col("_first")) - value_of(~F.col("_first"))).alias("_d"))
    extreme = F.count_if(F.round(F.abs("_d"), 9) >= F.round(F.abs("diff"), 9))
    return joined(perm, both, keys).groupBy(*keys).agg(extreme.alias("_x"))


def permutation_test(df: DataFrame, keys: list[str], unit: str, value: str, arm: str, n: int = 1000, statistic="mean", seed: int = 0, plus_one: bool = True) -> DataFrame:
    """(keys, n_a, n_b, diff, p) of arms 'a' and 'b': stat(a) - stat(b), two-sided.

    Differences count as extreme when they are equal to nine decimals. An empty
    side gives null; plus_one is the (count + 1) / (n + 1) estimate. A
    repetition gives arm a the units of the n_a smallest draws. Tests of up to
    SMALL_TEST units are repeated in one row, larger ones (means) in partial
    sums and a few units near the arms' border; other statistics sort every
    repetition.
    """
    stat = statistic_of(statistic)
    df = written(df.where(F.col(value).isNotNull()).select(*keys, unit, F.col(value).alias("_v"), F.col(arm).alias("_arm")), "arms")  # a row a unit, read several times
    a, b = (F.when(F.col("_arm") == x, F.col("_v")) for x in "ab")
    seen = df.groupBy(*keys).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), (stat(a) - stat(b)).alias("diff"))
    both = seen.where("n_a > 0 AND n_b > 0")
    size = F.col("n_a") + F.col("n_b")
    small, large = both.where(size <= SMALL_TEST), both.where(size > SMALL_TEST)
    of = lambda tests: joined(df, tests.select(*keys), keys, "left_semi") if keys else joined(df, tests.select(F.lit(1).alias("_1")), keys).drop("_1")
    if statistic == "mean":
        found = _small_tests(of(small), small, keys, unit, n, statistic, seed).unionByName(_large_means(of(large), large, keys, unit, n, seed))
    elif statistic == "median":
        found = _small_tests(of(small), small, keys, unit, n, statistic, seed).unionByName(_by_windows(of(large), large, keys, unit, n, stat, seed))
    else:
        found = _by_windows(of(both), both, keys, unit, n, stat, seed)
    x = F.sum("_x")
    out = found.groupBy(*keys).agg(((x + 1) / (n + 1) if plus_one else x / n).alias("p"))
    return joined(seen, out, keys, "left")


def paired_test(df: DataFrame, keys: list[str], unit: str, x: str, y: str, n: int = 1000, statistic="mean", seed: int = 0) -> DataFrame:
    """(keys, n_pairs, diff, p) of x - y by sign flips; pairs with a gap are left out."""
    stat = statistic_of(statistic)
    d = df.select(*keys, unit, (F.col(x) - F.col(y)).alias("_d")).where(F.col("_d").isNotNull())
    seen = d.groupBy(*keys).agg(F.count("*").alias("n_pairs"), stat(F.col("_d")).alias("diff"))
    test = [F.col(k).cast("string") for k in keys]
    sign = 1 - 2 * (draw(seed, *test, F.col("rep").cast("string"), F.col(unit).cast("string")) % 2)
    reps = repeated(d, n).groupBy(*keys, "rep").agg(stat(sign * F.col("_d")).alias("_s")).join(seen.select(*keys, "diff"), keys)
    p = (F.count_if(F.round(F.abs("_s"), 9) >= F.round(F.abs("diff"), 9)) + 1) / (n + 1)
    return seen.join(reps.groupBy(*keys).agg(p.alias("p")), keys, "left")


def binned_test(df: DataFrame, bin_: str, unit: str, metric: str, group: str, control: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """Per bin: all groups but the control against it; p may be 0, empty sides keep diff 0 and p 1, BH over all bins."""
    missing = [c for c in (bin_, unit, metric, group) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    rows = df.where(F.col(bin_).isNotNull() & F.col(group).isNotNull()).withColumn("_arm2", F.when(F.col(group) == control, "b").otherwise("a"))
    bins = rows.select(bin_).distinct()
    out = bins.join(permutation_test(rows, [bin_], unit, metric, "_arm2", n, "mean", seed, plus_one=False), bin_, "left")
    out = out.select(bin_, F.coalesce(F.when(F.col("p").isNotNull(), F.col("diff")), F.lit(0.0)).alias("diff"), F.coalesce("p", F.lit(1.0)).alias("p"))
    return bh_adjust(out).withColumn("significant", F.col("p_adj") < 0.05)


def pooled_control_test(rows: DataFrame, keys: list[str], unit: str, value: str, least: int = 3, n: int = 1000, seed: int = 0) -> DataFrame:
    """Tests of rows with arms, both sides of at least so many, adjusted over all tests."""
    out = permutation_test(rows, keys, unit, value, "arm", n, "mean", seed).where((F.col("n_a") >= least) & (F.col("n_b") >= least))
    return bh_adjust(out).withColumn("significant", F.coalesce(F.col("p_adj") < 0.05, F.lit(False)))

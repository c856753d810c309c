"""Orders, tops, seeded samples, products of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.operators.ranks import quantiles


def by_median(df: DataFrame, group: str, sub: str, metric: str) -> DataFrame:
    """Groups ranked by the median of their subgroups' medians, subgroups by their own; ties by name."""
    m = quantiles(df, [group, sub], metric, [0.5]).select(group, sub, F.col("q")[0].alias("m"))
    g = m.groupBy(group).agg(F.percentile("m", F.lit(0.5)).alias("gm"))
    ranked = g.withColumn("group_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gm", group)))  # one row a group
    out = m.join(ranked, group)
    return out.select(group, sub, "group_rank", F.row_number().over(Window.partitionBy(group).orderBy("m", sub)).alias("sub_rank"))


def explicit(df: DataFrame, column: str | list[str], order: list | dict[str, list]) -> DataFrame:
    """sort_rank by a stated order; values not listed have none. Several columns take an order each, by name, and get rank_<column>."""
    if isinstance(column, list):
        if not isinstance(order, dict):
            raise ValueError("several columns need an order for each, by name")
        missing = [c for c in column if c not in order]
        if missing:
            raise ValueError(f"no order for {missing}")
        for c in column:
            df = explicit(df, c, order[c]).withColumnRenamed("sort_rank", f"rank_{c}")
        return df
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.withColumn("sort_rank", F.nullif(at, F.lit(0)).cast("int"))


def group_order(groups: DataFrame, column: str) -> DataFrame:
    """PG<n> by number, other groups, controls last."""
    kind = F.when(F.col(column).startswith("PG"), 0).when(S.is_control_group(column), 2).otherwise(1)
    w = Window.partitionBy(F.lit(0)).orderBy(kind, S.first_number(column), column)
    return groups.withColumn("sort_rank", F.row_number().over(w))


def top(df: DataFrame, keys: list[str], by: str, n: int, ties: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), *ties)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def draw(seed: int, unit: Column) -> Column:
    """A portable pseudo-random sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), unit))


def sampled(df: DataFrame, keys: list[str], unit: Column, n: int, seed: int, ties: list[str]) -> DataFrame:
    """Exactly n rows of each group (all, if fewer), by seed."""
    w = Window.partitionBy(*keys).orderBy(draw(seed, unit), *ties)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def stratified(df: DataFrame, stratum: str, unit: Column, target: int, seed: int, ties: list[str]) -> DataFrame:
    """About target rows with the strata's shares kept (each stratum's part rounded, halves to even)."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    part = sizes.join(F.broadcast(total)).select(stratum, F.bround(F.lit(float(target)) * F.col("_n") / F.col("_all")).alias("_k"))
    w = Window.partitionBy(stratum).orderBy(draw(seed, unit), *ties)
    return df.withColumn("_r", F.row_number().over(w)).join(part, stratum).where(F.col("_r") <= F.col("_k")).drop("_r", "_k")


def first_files(files: DataFrame, folder: str, processed: Column, order: list[str], n: int) -> DataFrame:
    """The first n files of a folder, those not processed before the others."""
    w = Window.partitionBy(folder).orderBy(processed, *order)
    return files.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def key_product(df: DataFrame, keys: list[str]) -> DataFrame:
    """All combinations of the keys' values (the product is the result)."""
    return reduce(DataFrame.crossJoin, [df.select(k).distinct() for k in keys])

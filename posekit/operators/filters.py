"""Row and column filters. Null handling follows data frames: a missing value is not in a list."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posekit.functions.scalars import contains_any


def time_range(df: DataFrame, start: float | None = None, end: float | None = None, column: str = "time") -> DataFrame:
    """Closed at both ends; either end may be open."""
    if start is not None:
        df = df.where(F.col(column) >= start)
    return df if end is None else df.where(F.col(column) <= end)


def exclude_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is not listed; missing values stay."""
    return df.where(F.coalesce(~F.col(column).isin(values), F.lit(True)))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with the value; none if there is no such column."""
    return df.where(F.col(column) == value) if column in df.columns else df.limit(0)


def members(df: DataFrame, column: str, values: list, complement: bool = False) -> DataFrame:
    return exclude_values(df, column, values) if complement else df.where(F.col(column).isin(values))


def without_tokens(df: DataFrame, column: str, tokens: list[str]) -> DataFrame:
    """Rows whose text holds none of the tokens, case ignored."""
    return df.where(~contains_any(column, tokens))


def at_most_tracks(df: DataFrame, most: int, recording: str = "recording", track: str = "track") -> DataFrame:
    """Recordings of at most so many tracks."""
    few = df.groupBy(recording).agg(F.count_distinct(track).alias("_n")).where(F.col("_n") <= most)
    return df.join(few.select(recording), recording, "left_semi")


def clean(df: DataFrame, metric: str, group: str) -> DataFrame:
    """Metric as a number; rows without it go, and with them groups that have none."""
    df = df.withColumn(metric, F.expr(f"try_cast({metric} AS double)"))
    has = F.count(metric).over(Window.partitionBy(group)) > 0
    return df.where(F.col(group).isNotNull()).withColumn("_has", has).where(F.col("_has") & F.col(metric).isNotNull()).drop("_has")


def groups_like(df: DataFrame, column: str, values: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """Groups listed by value, or whose name contains a pattern."""
    keep = F.lit(False)
    if values:
        keep = keep | F.col(column).isin(values)
    for p in patterns or []:
        keep = keep | F.contains(F.col(column), F.lit(p))
    return df.where(keep)


def reaches(df: DataFrame, subject: str, condition: Column) -> DataFrame:
    """All rows of subjects for which the condition holds at least once."""
    ok = df.groupBy(subject).agg(F.bool_or(condition).alias("_ok")).where("_ok")
    return df.join(ok.select(subject), subject, "left_semi")


def long_enough(df: DataFrame, subject: str, least: float, column: str = "time") -> DataFrame:
    """All rows of subjects whose last time is at least so late."""
    ok = df.groupBy(subject).agg(F.max(column).alias("_t")).where(F.col("_t") >= least)
    return df.join(ok.select(subject), subject, "left_semi")


def feature_columns(columns: list[str], groups: dict[str, str], chosen: list[str], also: list[str] = (), exclude: str = "centre") -> list[str]:
    """Columns matched by the chosen groups' patterns or holding an added text, without the excluded text."""
    unknown = [g for g in chosen if g not in groups]
    if unknown:
        raise ValueError(f"unknown feature groups {unknown}; known: {sorted(groups)}")
    out = [c for c in columns if (any(re.search(groups[g], c) for g in chosen) or any(a in c for a in also)) and exclude not in c]
    if not out:
        raise ValueError("no feature columns left")
    return out


def numeric_split(df: DataFrame, metadata: list[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric columns, others); named metadata counts as other."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in metadata]
    return numeric, [c for c in df.columns if c not in numeric]


def columns_matching(df: DataFrame, pattern: str, negate: bool = False) -> DataFrame:
    names = [c for c in df.columns if bool(re.search(pattern, c)) != negate]
    return df.select(*[F.col(f"`{c}`") for c in names])


def first_of_repeated_columns(df: DataFrame) -> DataFrame:
    """Columns of repeated name: the first of each."""
    names = [f"_{k}" for k in range(len(df.columns))]
    keep = [k for k, c in enumerate(df.columns) if c not in df.columns[:k]]
    return df.toDF(*names).select(*[F.col(names[k]).alias(df.columns[k]) for k in keep])


def resolve_node(nodes: list[str], wanted: str) -> str:
    """A node's own spelling, found with case ignored."""
    found = {n.lower(): n for n in nodes}.get(wanted.lower())
    if found is None:
        raise KeyError(f"node {wanted!r} not found; available: {sorted(nodes)}")
    return found


def wide_presence(df: DataFrame) -> Column:
    """Whether any x_/y_ column of a wide row is present."""
    return F.coalesce(*[F.col(c) for c in df.columns if re.match("[xy]_", c)]).isNotNull()


def presence(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame: whether any node has a coordinate."""
    return points.groupBy(*keys).agg(F.max(F.col("x").isNotNull() | F.col("y").isNotNull()).alias("present"))


def scopes(df: DataFrame, shared_end: float, long_flag: Column, column: str = "time") -> tuple[DataFrame, DataFrame]:
    """(rows of all protocols up to the shared end, rows of the long protocol)."""
    return df.where(F.col(column) <= shared_end), df.where(long_flag)


def scoped(df: DataFrame, shared_end: float, long_flag: Column, column: str = "time", out: str = "scope") -> DataFrame:
    """Rows once for each scope they are in: `shared` up to the shared end, `long` for the long protocol; one pass for both."""
    at = F.array(F.when(F.col(column) <= shared_end, F.lit("shared")), F.when(long_flag, F.lit("long")))
    return df.withColumn(out, F.explode(F.filter(at, lambda s: s.isNotNull())))


def without_start(df: DataFrame, frames: int, keys: list[str], order_by: str = "frame") -> DataFrame:
    """Drop the first frames of every series."""
    w = Window.partitionBy(*keys).orderBy(order_by)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > frames).drop("_r")


def retry_groups(df: DataFrame, key: str, genotype: str, missing: DataFrame) -> DataFrame:
    """All rows of groups whose key, or a genotype in them, is on the list (one column `item`)."""
    items = missing.select(F.col("item").alias("_item")).distinct()
    pairs = df.select(key, F.explode(F.array(F.col(key).cast("string"), F.col(genotype).cast("string"))).alias("_item")).distinct()
    return df.join(pairs.join(items, "_item", "left_semi").select(key).distinct(), key, "left_semi")


def missing_list(text: DataFrame) -> DataFrame:
    """Items of a text list: header, comment and empty lines go, bullets are cut."""
    line = F.trim(F.regexp_replace("value", r"^\s*[-*]\s*", ""))
    return text.select(line.alias("item")).where((F.col("item") != "") & ~F.col("item").rlike(r"^(#|=|Missing)|:$"))

"""Name harmonisation: maps, cascades, collisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_map(df: DataFrame, columns: list[str], value: str, later_wins: bool = True) -> DataFrame:
    """(key, value) from several source columns; one value a key by column order, lower-case variants where free.

    later_wins: a key found in several columns takes the last column's value,
    else the first one's. Ties inside a column take the largest value.
    """
    n = len(columns)
    parts = [df.select(F.col(c).alias("key"), F.col(value).alias("value"), F.lit(k if later_wins else n - k).alias("p")) for k, c in enumerate(columns)]
    own = reduce(DataFrame.unionByName, parts).where(F.col("key").isNotNull())
    lowered = parts[0].withColumn("key", F.lower("key")).withColumn("p", F.lit(-1))
    every = own.unionByName(lowered)
    return every.groupBy("key").agg(F.max_by("value", F.struct("p", "value")).alias("value"))


def candidates(name):
    """Array of (key, priority) to try: the name, trimmed, last parentheses, before them, first line, in lower case."""
    c = F.col(name)
    tries = [c, F.trim(c), F.regexp_extract(c, r"\(([^()]*)\)[^()]*$", 1), F.trim(F.split_part(c, F.lit("("), F.lit(1))), F.trim(F.split_part(c, F.lit("\n"), F.lit(1)))]
    out = [F.struct(t.alias("key"), F.lit(k).alias("priority"), F.lit(False).alias("lowered")) for k, t in enumerate(tries)]
    return F.array(*out, F.struct(F.lower(c).alias("key"), F.lit(9).alias("priority"), F.lit(True).alias("lowered")))


def resolve(df: DataFrame, key: str, name: str, mapping: DataFrame) -> DataFrame:
    """Adds `resolved`: the value of the first candidate key that the map has, else the name itself.

    Distinct names are resolved, so repeated ones cost one lookup.
    """
    distinct = df.select(name).distinct()
    tried = distinct.select(name, F.explode(candidates(name)).alias("t")).select(name, "t.*")
    lookup = mapping.select("key", "value", F.lit(False).alias("lowered")).union(mapping.select(F.lower("key"), "value", F.lit(True)))
    best = tried.join(lookup, ["key", "lowered"]).groupBy(name).agg(F.min_by("value", F.struct("priority", "value")).alias("_v"))
    return df.join(best, name, "left").withColumn("resolved", F.coalesce("_v", name)).drop("_v")


def match_prefix(df: DataFrame, key: str, name: str, stems: DataFrame) -> DataFrame:
    """Adds `matched`: the stem equal to the name (case ignored too), else one that the name continues after a blank or `(`.

    A name's possible stems are what stands before each blank or parenthesis,
    so the prefix match is an equi join; the first map wins, then the longest stem.
    """
    c = F.col(name)
    words = F.split(c, r"[ (]")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.trim(F.call_function("substring_index", F.regexp_replace(c, r" ?\(", " "), F.lit(" "), k)))
    tried = df.select(name, F.explode(F.array_distinct(F.concat(heads, F.array(c, F.lower(c))))).alias("stem")).distinct()
    exact = F.lower("stem") == F.lower(name)
    best = tried.join(stems, "stem").groupBy(name).agg(F.max_by("stem", F.struct(exact.cast("int"), -F.col("map"), F.length("stem"))).alias("matched"))
    return df.join(best, name, "left")


def through(df: DataFrame, new: DataFrame, on: str, own: str) -> DataFrame:
    """Adds `value`: the new map's value for the key, else the row's own."""
    return df.join(new.select(on, F.col("value").alias("_v")), on, "left").withColumn("value", F.coalesce("_v", own)).drop("_v")


def collisions(df: DataFrame, name: str, order_by: str) -> DataFrame:
    """Adds `rank` within equal names by order; rank 1 is the plan, others are reported."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(name).orderBy(order_by)))

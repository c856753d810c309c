"""Readers and writers: pose tensors, tables, metadata, file inventories."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else our own default (local sessions only)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or "file:///tmp/posekit-shared").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/posekit/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, read back: what many results are made of is computed once, and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing data is null everywhere; NaN comes from array files only."""
    doubles = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles}) if doubles else df


def explode_tensor(recordings: DataFrame, fps: float, object_type: str = "fly") -> DataFrame:
    """Point rows of `tracks[track][axis][node][frame]`, `node_names`, optional `track_names`.

    frame from 1, time = frame / fps, track_id by name or track_<i>, object <type>_<name or i>.
    """
    names = F.col("track_names") if "track_names" in recordings.columns else F.array().cast("array<string>")
    t = recordings.select("recording", "node_names", names.alias("names"), F.posexplode("tracks").alias("t", "xy"))
    name = F.get("names", F.col("t"))
    n = t.select("recording", "node_names", "t", name.alias("name"), F.posexplode(F.arrays_zip(F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))).alias("n", "s"))
    p = n.select("recording", "t", "name", F.col("node_names")[F.col("n")].alias("node"), F.posexplode(F.arrays_zip(F.col("s.x").alias("x"), F.col("s.y").alias("y"))).alias("f", "c"))
    number = (F.col("t") + 1).cast("string")
    return p.select(
        "recording",
        F.coalesce("name", F.concat(F.lit("track_"), number)).alias("track_id"),
        F.concat(F.lit(f"{object_type}_"), F.coalesce("name", number)).alias("object"),
        (F.col("f") + 1).alias("frame"),
        ((F.col("f") + 1) / F.lit(float(fps))).alias("time"),
        "node",
        F.nanvl(F.col("c.x"), F.lit(None).cast("double")).alias("x"),
        F.nanvl(F.col("c.y"), F.lit(None).cast("double")).alias("y"),
    )


def single_object(recordings: DataFrame, fps: float) -> DataFrame:
    """Point rows of the first track only."""
    return explode_tensor(recordings.withColumn("tracks", F.slice("tracks", 1, 1)), fps)


def node_positions(points: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """Per series, the (x, y) list of a node in frame order (one series is one track)."""
    rows = points.where(F.col("node") == node).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))).alias("p"))
    return rows.select(*keys, F.transform("p", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"))).alias("positions"))


def with_scores(points: DataFrame, scores: DataFrame | None, keys: list[str]) -> DataFrame:
    """Adds the optional score; null where there is none."""
    if scores is None:
        return points.withColumn("score", F.lit(None).cast("double"))
    return points.join(scores.select(*keys, "score"), keys, "left")


def repaired_paths(paths: DataFrame, prefixes: dict[str, str], inventory: DataFrame) -> DataFrame:
    """source: the path with a known prefix replaced if the inventory has it, else a sibling of its stem without _tracked, else null."""
    fixed = F.col("path")
    for a, b in prefixes.items():
        fixed = F.when(F.col("path").startswith(a), F.concat(F.lit(b), F.substring(F.col("path"), len(a) + 1, 1 << 30))).otherwise(fixed)
    have = inventory.select(F.col("path").alias("_have")).distinct()
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.[^./]*$", ""), "_tracked$", "")
    siblings = inventory.groupBy(stem("path").alias("_stem")).agg(F.min("path").alias("_sibling"))
    out = paths.withColumn("_fixed", fixed).withColumn("_stem", stem("path"))
    out = out.join(have, F.col("_fixed") == F.col("_have"), "left").join(siblings, "_stem", "left")
    return out.withColumn("source", F.coalesce("_have", "_sibling")).drop("_fixed", "_have", "_stem", "_sibling")


def read_csv(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    """Typed CSV; optionally only columns that match a pattern."""
    import re

    df = spark.read.schema(schema).option("header", True).csv(path)
    return df if pattern is None else df.select(*[c for c in df.columns if re.search(pattern, c)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] = ()) -> None:
    """Parquet, unless the target exists and overwrite is not asked for (then it is an error)."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by).parquet(path)


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "modificationTime", "length")


def matching(files: DataFrame, include: list[str], exclude: list[str] = (), path: str = "path") -> DataFrame:
    """Distinct files that match some include pattern and no exclude pattern (regular expressions, case ignored)."""
    some = lambda ps: F.lit(False) if not ps else F.col(path).rlike("(?i)" + "|".join(f"(?:{p})" for p in ps))
    return files.where(some(include) & ~some(exclude)).dropDuplicates([path])


def metadata_rows(df: DataFrame, text: str, keys: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """(keys, arena, metadata map) of JSON {"Variable": [...], "Arena1": [...], ...}; variables in lower case, renamed first."""
    lists = df.select(*keys, F.from_json(text, "map<string, array<string>>").alias("m"))

    def name(v: Column) -> Column:
        for a, b in (rename or {}).items():
            v = F.when(v == a, F.lit(b)).otherwise(v)
        return F.lower(v)

    rows = lists.select(*keys, F.transform(F.col("m")["Variable"], name).alias("v"), F.explode(F.map_filter("m", lambda k, _: k != "Variable")).alias("arena", "values"))
    return rows.select(*keys, "arena", F.map_from_arrays("v", "values").alias("metadata"))


def unfinished(inputs: DataFrame, outputs: DataFrame, render: bool = False) -> DataFrame:
    """Inputs (stem) without finished outputs: .slp and .h5 (and the annotated video, if asked for), or an .empty marker."""
    out = outputs.select(F.regexp_extract("path", r"([^/]+?)_tracked(?:_annotated)?\.[^.]+$", 1).alias("stem"), "path")
    has = lambda p: F.bool_or(F.col("path").rlike(p))
    done = (has(r"_tracked\.slp$") & has(r"_tracked\.h5$")) | has(r"_tracked\.empty$")
    if render:
        done = done & has(r"_tracked_annotated\.mp4$")
    finished = out.groupBy("stem").agg(done.alias("done")).where("done").select("stem")
    return inputs.join(finished, "stem", "left_anti")

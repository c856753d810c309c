"""Features, scaling, principal components, clusters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posekit.sources.io import written


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus mean over population std; a zero std counts as 1. One pass for all moments (one row)."""
    m = df.agg(*[F.avg(c).alias(f"_m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"_s{k}") for k, c in enumerate(columns)])
    scaled = {c: (F.col(c) - F.col(f"_m{k}")) / F.when(F.col(f"_s{k}") == 0, F.lit(1.0)).otherwise(F.col(f"_s{k}")) for k, c in enumerate(columns)}
    return df.join(F.broadcast(m)).withColumns(scaled).drop(*[f"_{x}{k}" for x in "ms" for k in range(len(columns))])


def components_for(explained: list[float], share: float) -> int:
    """Fewest components that explain the share."""
    return int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)


def principal_components(df: DataFrame, columns: list[str], share: float = 0.95, k: int | None = None, out: str = "scores") -> tuple[DataFrame, list[float]]:
    """df with `out` (array): scores of standardised columns; the largest loading of each component is positive.

    Returns the explained shares too. Keys and metadata stay in the row.
    """
    scaled = standardised(df, columns).withColumn("_v", array_to_vector(F.array(*columns)))
    model = PCA(k=min(len(columns), k or len(columns)), inputCol="_v", outputCol="_p").fit(scaled)
    shares = [float(x) for x in model.explainedVariance]
    n = k or components_for(shares, share)
    load = model.pc.toArray()[:, :n]
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])
    p = vector_to_array("_p")
    scores = F.array(*[p[i] * float(sign[i]) for i in range(n)])
    kept = [F.col(c) for c in df.columns if c not in columns]
    return model.transform(scaled).select(*kept, scores.alias(out)), shares[:n]


def clusters(df: DataFrame, features: str, k: int = 20, seed: int = 0, out: str = "cluster") -> DataFrame:
    """k-means on an array column."""
    rows = df.withColumn("_f", array_to_vector(features))
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol=out).fit(rows)
    return model.transform(rows).drop("_f")


#: Rows of a tile, and distance sums (rows of a tile x clusters) that a task may hold.
TILE_ROWS, MOST_SUMS = 512, 20_000_000
#: Rows of a tile that meet another tile at once, so that their distances stay in the cache.
STRIP_ROWS = 256
#: Runs of rows of the same clusters in a tile up to which runs are summed one by one.
FEW_RUNS = 24
#: Bytes of a batch of tiles between Spark and Python, and of the tiles that a task meets.
TILE_BYTES, MET_BYTES = 8 << 20, 64 << 20


def tiles(df: DataFrame, key: str, features: str, clusterings: list[str], names: list[list]) -> DataFrame:
    """(_tile, _keys, _mine, _x): up to TILE_ROWS rows each, clusters as positions in the names of all clusterings, features as doubles in a row.

    Written once. Rows of the same clusters lie side by side; the key cuts large clusters.
    """
    first = np.cumsum([0, *map(len, names)])
    at = [{n: k + int(a) for k, n in enumerate(each)} for each, a in zip(names, first, strict=False)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), TILE_ROWS):
                part = pdf.iloc[a : a + TILE_ROWS]
                x = np.array(part[features].tolist(), float)
                mine = np.array([[place[c] for c in part[name]] for name, place in zip(clusterings, at, strict=True)], np.int32).T
                yield pd.DataFrame({"_tile": [uuid.uuid4().hex], "_keys": [part[key].tolist()], "_mine": [mine.tobytes()], "_x": [x.tobytes()]})

    dealt = df.select(key, *clusterings, features).repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, *clusterings, key)
    rows = dealt.sortWithinPartitions(*clusterings, key).mapInPandas(run, f"_tile string, _keys array<{dict(df.dtypes)[key]}>, _mine binary, _x binary")
    return written(rows, "tiles")


def distances(x: np.ndarray, y: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances of all rows of x and y, made in out: by products about the mean of y; near ones, where these cancel, by differences."""
    centre = y.mean(axis=0)
    centre[~np.isfinite(centre)] = 0.0
    u, v = x - centre, y - centre
    uu, vv = (u**2).sum(axis=1), (v**2).sum(axis=1)
    square = np.matmul(np.column_stack([-2 * u, uu, np.ones(len(u))]), np.vstack([v.T, np.ones(len(v)), vv]), out=out)
    if not square.min() > 1e-4 * (uu.max() + vv.max()):
        i, j = np.nonzero(~(square > 1e-4 * (uu[:, None] + vv[None])))
        if 8 * len(i) > square.size:
            square[:] = sum((x[:, d, None] - y[None, :, d]) ** 2 for d in range(x.shape[1]))
        else:
            for a in range(0, len(i), 20_000):
                at = slice(a, a + 20_000)
                square[i[at], j[at]] = ((x[i[at]] - y[j[at]]) ** 2).sum(axis=1)
    return np.sqrt(square, out=square)


def add_sums(total: np.ndarray, x: np.ndarray, y: np.ndarray, codes: np.ndarray, room: np.ndarray) -> None:
    """Adds to total (clusters x rows of x) the distances of each row of x to the rows of y, whose clusters are codes (rows of y x clusterings).

    room (TILE_ROWS x STRIP_ROWS) holds the distances: memory that is asked for anew each time costs more than they do.
    """
    starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
    few = len(starts) <= FEW_RUNS
    of = codes[starts] if few else codes
    member = np.zeros((len(total), len(of)))
    member[of, np.arange(len(of))[:, None]] = 1.0
    runs, ones = list(zip(starts, [*starts[1:], len(y)], strict=True)), np.ones(len(y))
    for a in range(0, len(x), STRIP_ROWS):
        part = x[a : a + STRIP_ROWS]
        d = distances(y, part, room[: len(y), : len(part)])
        total[:, a : a + STRIP_ROWS] += member @ (np.stack([ones[b:z] @ d[b:z] for b, z in runs]) if few else d)


def distance_sums(scored: DataFrame, every: DataFrame, n_clusterings: int, n_clusters: int) -> DataFrame:
    """(_tile, _keys, _mine, _sums): sums of distances from each row of a scored tile to the rows of each cluster, of the tiles that met in a task.

    All pairs of tiles are Spark's cross join, in which a task meets MET_BYTES of
    every tile, whatever their number; Python holds two tiles and the sums of one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total, room = None, None, np.empty((TILE_ROWS, STRIP_ROWS))
        done = lambda: pd.DataFrame({"_tile": [held[0]], "_keys": [held[1]], "_mine": [held[2]], "_sums": [total.tobytes()]})
        for pdf in batches:
            for tile, keys, mine, x, codes, y in zip(*[pdf[c] for c in ("_tile", "_keys", "_mine", "_x", "_codes", "_y")], strict=True):
                if held is None or held[0] != tile:
                    if held is not None:
                        yield done()
                    held, total = (tile, keys, mine), np.zeros((n_clusters, len(keys)))
                codes = np.frombuffer(codes, np.int32).reshape(-1, n_clusterings)
                add_sums(total, np.frombuffer(x).reshape(len(keys), -1), np.frombuffer(y).reshape(len(codes), -1), codes, room)
        if held is not None:
            yield done()

    spark = scored.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TILE_BYTES))
    left = scored.repartition(2 * spark.sparkContext.defaultParallelism)
    size = every.agg(F.sum(F.length("_x") + F.length("_mine"))).first()[0] or 0
    right = every.select(F.col("_mine").alias("_codes"), F.col("_x").alias("_y")).coalesce(1 + size // MET_BYTES)
    pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))
    return pairs.mapInPandas(run, f"_tile string, _keys {dict(scored.dtypes)['_keys']}, _mine binary, _sums binary")


def summed(rows: DataFrame, key: str, features: str, clusterings: list[str], sizes: list[dict], most: int | None, seed: int) -> DataFrame:
    """distance_sums of all rows, or of `most` drawn by a hash of their key, to the clusters of all clusterings; sizes has the rows of each cluster."""
    names = [sorted(each) for each in sizes]
    n_clusters = sum(map(len, names))
    if n_clusters * TILE_ROWS > MOST_SUMS:
        raise ValueError(f"rows of a tile x clusters are more than {MOST_SUMS}")
    scored = every = tiles(rows, key, features, clusterings, names)
    if most is not None and sum(sizes[0].values()) > most:
        scored = tiles(rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(most), key, features, clusterings, names)
    return distance_sums(scored, every, len(clusterings), n_clusters)


def scores_of(parts: pd.DataFrame, sizes: list[dict]) -> Iterator[tuple]:
    """(codes, alone, own, other, silhouette) of a tile's rows, for each clustering in turn; parts has the tile's sums, as summed() returns them."""
    mine = np.frombuffer(parts["_mine"].iloc[0], np.int32).reshape(-1, len(sizes))
    sums = sum(np.frombuffer(t).reshape(-1, len(mine)) for t in parts["_sums"])
    at, first = np.arange(len(mine)), 0
    for n, each in enumerate(sizes):
        codes, total = mine[:, n] - first, sums[first : first + len(each)].T
        size = np.array([each[c] for c in sorted(each)], float)
        first += len(each)
        alone = size[codes] == 1
        own = total[at, codes] / np.maximum(size[codes] - 1, 1)
        mean = total / size
        mean[at, codes] = np.inf
        other = mean.min(axis=1)
        most_of = np.maximum(own, other)
        yield codes, alone, own, other, np.where(alone | (most_of == 0), 0.0, (other - own) / np.where(most_of == 0, 1.0, most_of))


def silhouettes(df: DataFrame, key: str, features: str, cluster: str, most: int | None = None, seed: int = 0) -> DataFrame:
    """(key, cluster, own, other, silhouette) on Euclidean distances to all rows.

    own: mean distance to the other rows of the row's cluster; other: the least
    mean distance to another cluster. Exact for every row returned: all rows, or
    `most` of them, drawn by a hash of their key, if given. A cluster of one row
    has silhouette 0. Rows without a cluster or features take no part. The work
    is rows scored x rows, in tiles of bounded size.
    """
    rows = df.where(F.col(features).isNotNull() & F.col(cluster).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(cluster).count().collect()}  # one row a cluster
    names = sorted(sizes)
    if len(names) < 2:
        raise ValueError("silhouettes need two clusters at least")
    kind = dict(df.dtypes)

    def finish(parts: pd.DataFrame) -> pd.DataFrame:
        codes, alone, own, other, s = next(scores_of(parts, [sizes]))
        own = [None if a else v for a, v in zip(alone, own, strict=True)]
        return pd.DataFrame({key: list(parts["_keys"].iloc[0]), cluster: [names[k] for k in codes], "own": pd.Series(own, dtype="float64"), "other": other, "silhouette": s})

    sums = summed(rows, key, features, [cluster], [sizes], most, seed)
    return sums.groupBy("_tile").applyInPandas(finish, f"`{key}` {kind[key]}, `{cluster}` {kind[cluster]}, own double, other double, silhouette double")


def silhouette(df: DataFrame, key: str, features: str, cluster: str, most: int | None = None) -> float:
    """Mean silhouette of the scored rows."""
    return float(silhouettes(df, key, features, cluster, most).agg(F.avg("silhouette")).first()[0])


def mean_silhouettes(df: DataFrame, key: str, features: str, clusterings: list[str], most: int | None = None, seed: int = 0) -> list[float | None]:
    """Mean silhouette of the scored rows by each clustering, a column each; null where all are one cluster.

    The rows of all clusterings are the same, so each distance is made once for
    all of them. Rows without features or without a cluster of any clustering
    take no part.
    """
    rows = written(df.select(key, features, *clusterings).where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (features, *clusterings)])), "labelled")
    sizes = {c: {r[0]: r[1] for r in rows.groupBy(c).count().collect()} for c in clusterings}  # one row a cluster
    used = [c for c in clusterings if len(sizes[c]) > 1]
    if not used:
        return [None] * len(clusterings)
    each = [sizes[c] for c in used]

    def finish(parts: pd.DataFrame) -> pd.DataFrame:
        s = [s for *_, s in scores_of(parts, each)]
        return pd.DataFrame({"name": used, "total": [v.sum() for v in s], "n": [len(v) for v in s]})

    sums = summed(rows, key, features, used, each, most, seed)
    tiled = sums.groupBy("_tile").applyInPandas(finish, "name string, total double, n long")
    got = {r[0]: r[1] for r in tiled.groupBy("name").agg(F.sum("total") / F.sum("n")).collect()}  # one row a clustering
    return [got.get(c) for c in clusterings]


def sweep(df: DataFrame, key: str, features: str, ks: list[int], seeds: list[int], best: int = 5, most: int | None = None) -> DataFrame:
    """(k, seed, silhouette) of the best settings; one fit a setting, data cached once, all scored in one pass over pairs. A fit that leaves one cluster scores null."""
    spark, rows = df.sparkSession, df.select(key, features).persist()
    settings = [(k, s) for k in ks for s in seeds]
    names = [f"_setting{n}" for n in range(len(settings))]
    try:
        labelled = rows
        for name, (k, s) in zip(names, settings, strict=True):
            labelled = clusters(labelled, features, k, s, name)
        scores = mean_silhouettes(labelled, key, features, names, most)
    finally:
        rows.unpersist()
    got = [(*setting, score) for setting, score in zip(settings, scores, strict=True)]
    return spark.createDataFrame(got, "k int, seed int, silhouette double").orderBy(F.desc_nulls_last("silhouette"), "k", "seed").limit(best)


def fitted_scales(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first half of a model as a table: (name, mean, std), one row a column; the std of a constant is 1."""
    m = df.agg(*[F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.when(F.min(c) == F.max(c), F.lit(1.0)).otherwise(F.stddev_pop(c)).alias("std")).alias(f"_{k}") for k, c in enumerate(columns)])
    return m.select(F.inline(F.array(*[f"_{k}" for k in range(len(columns))])))


def projected(df: DataFrame, columns: list[str], scales: DataFrame, loadings: list[list[float]], out: str = "scores") -> DataFrame:
    """Scores by a given model: standardised columns times loadings (one list a component), as Column arithmetic."""
    by = {r["name"]: (r["mean"], r["std"]) for r in scales.collect()}  # one row a column
    z = [(F.col(c) - F.lit(by[c][0])) / F.lit(by[c][1]) for c in columns]
    score = lambda w: sum((x * F.lit(float(v)) for x, v in zip(z[1:], w[1:], strict=True)), z[0] * F.lit(float(w[0])))
    return df.withColumn(out, F.array(*[score(w) for w in loadings]))


def assigned(df: DataFrame, features: str, centres: list[list[float]], out: str = "cluster", distance: str | None = None) -> DataFrame:
    """Rows with their nearest given centre (from 0; ties to the first), and the distance to it if named."""
    square = lambda c: sum((F.pow(F.col(features)[k] - F.lit(float(v)), F.lit(2)) for k, v in enumerate(c)), F.lit(0.0))
    near = F.array_min(F.array(*[F.struct(square(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]))
    df = df.withColumn("_near", F.when(F.col(features).isNotNull(), near))
    extra = {distance: F.sqrt("_near.d")} if distance else {}
    return df.withColumns({out: F.col("_near.k")} | extra).drop("_near")

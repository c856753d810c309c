"""Nearest neighbours by largest inner product over an inverted multi-index.

Both halves of the vectors are quantised separately (K centroids a half, fitted
by k-means on part of a bounded sample), so K*K cells hold all rows. A query
ranks the centroids of each half by inner product and pops centroid pairs in
falling order of the summed score from a heap, until the popped cells hold a
share of all rows. That share is measured on the rest of the sample, which the
centroids have not seen: it is what TARGET of the near rows there needed. Only
the entries of popped cells are reranked, by the exact inner product in double
precision, cell by cell.

Cells are stored in tiles of at most TILE rows (several centroid lists, or a part
of a long one), and a query goes to the tiles in which it has an open cell.
Queries come in blocks of BLOCK, so a tile is copied once a block. Compared are a
stated query set and all rows, in blocks.

Defined cases: vectors that are null, zero, hold null or non-finite components
or are not of the most common length (of equally common ones the shortest) take
no part, as query or candidate; repeated rows are candidates each; a vec_id with
several vectors is asked once, with the smallest of them; ties go
to the smaller vec_id; fewer candidates than k are all returned; no valid
vector gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posekit.llm.common import hold, stored

CENTROIDS = 256
#: Rows a centroid at least, in the part of the sample that fits them.
LEAST_ROWS = 32
SAMPLE = 16_384
#: Part of the sample that fits the centroids; the rest measures the share to open.
FITTED = 0.75
ASKED = 256
#: Part of the near rows of the measuring sample that the opened cells must hold.
TARGET = 0.94
TILE = 8_192
BLOCK = 32_768
SEED = 17


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).select("d")
    return rows.join(F.broadcast(size), F.size("v") == F.col("d")).select("vec_id", "v")  # one row


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def fit(sample: DataFrame, half: slice, dims: int, k: int = CENTROIDS) -> np.ndarray:
    """k-means centroids of one half."""
    part = sample.select(array_to_vector(F.slice("v", half.start + 1, half.stop - half.start)).alias("features"))
    return np.array(KMeans(k=k, seed=SEED, maxIter=8, initSteps=1).fit(part).clusterCenters())


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)


def best_pairs(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(a, b, score) by falling summed score. The heap holds the next pair of each first centroid begun."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    s, t = (-first[a]).tolist(), (-second[b]).tolist()
    heap, n = [(s[0] + t[0], 0, 0)], len(t)
    while heap:
        score, i, j = heap[0]
        yield a[i], b[j], -score
        if j + 1 < n:
            heapq.heapreplace(heap, (s[i] + t[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(s):
            heapq.heappush(heap, (s[i + 1] + t[0], i + 1, 0))


def least_score(first: np.ndarray, second: np.ndarray, sizes: list[list[int]], enough: float) -> float:
    """The score of the last pair popped, when the popped cells hold enough rows."""
    held, score = 0, -np.inf
    for a, b, score in best_pairs(first, second):
        held += sizes[a][b]
        if held >= enough:
            return score
    return -np.inf


def share_to_open(x: np.ndarray, halves: list[slice], books: list[np.ndarray], near: int, target: float = TARGET) -> float:
    """Share of rows to read for `target` of the `near` nearest rows, measured on rows x."""
    if len(x) < 64:
        return 1.0
    n = min(ASKED, len(x) // 4)
    q, rows = x[:n], x[n:]
    near = min(near, len(rows))
    code = [nearest(rows[:, h], b) if b.size else np.zeros(len(rows), int) for h, b in zip(halves, books, strict=True)]
    guess = sum((q[:, h] @ b.T)[:, c] for h, b, c in zip(halves, books, code, strict=True) if b.size)
    best = np.argpartition(-(q @ rows.T), near - 1, axis=1)[:, :near]
    limit = np.take_along_axis(guess, best, axis=1)
    read = (guess[:, None, :] >= limit[:, :, None]).mean(axis=2)
    return float(np.quantile(read, target))


def top_of(scores: np.ndarray, q: np.ndarray, x: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each row of scores, recomputed row by row; -inf is no candidate."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    else:
        least = np.full(len(scores), -np.inf)
    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()  # scores of whole blocks differ in the last bits
    r, c = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
    exact = (q[r] * x[c]).sum(axis=1)
    order = np.lexsort((xid[c], -exact, r))
    r, c, exact = r[order], c[order], exact[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < k
    return pd.DataFrame({"query_id": qid[r[keep]], "vec_id": xid[c[keep]], "score": exact[keep]})


def dealt(counts: dict[int, int], tile: int) -> dict[int, tuple[int, int]]:
    """First tile and number of tiles of each centroid list: short lists share a tile, a long one has several of its own."""
    out, last, room = {}, -1, 0
    for c, n in sorted(counts.items()):
        parts = -(-n // tile)
        if n > tile:
            out[c], last, room = (last + 1, parts), last + parts, 0
            continue
        if n > room:
            last, room = last + 1, tile
        out[c], room = (last, 1), room - n
    return out


def search(rows: DataFrame, is_query, k: int = 20, centroids: int = CENTROIDS, sample_rows: int = SAMPLE, tile: int = TILE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score, n_read): k nearest of every row for which is_query holds; n_read: rows scored for the query."""
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score double, n_read long"
    vectors = stored(valid_vectors(rows), "vectors")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], result)
    share = min(1.0, sample_rows / n)
    draw = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20))
    cut_off = int(share * (1 << 20))
    sample = stored(vectors.withColumn("draw", draw).where(F.col("draw") < max(1, cut_off)), "sample")  # about sample_rows, by construction
    fit_rows, rest = sample.where(F.col("draw") < FITTED * cut_off), sample.where(F.col("draw") >= FITTED * cut_off)
    seen = matrix(rest.orderBy("draw", "vec_id").select("v").toPandas()["v"])
    if not (n_fit := fit_rows.count()):
        fit_rows, n_fit = vectors.limit(1), 1
    dims = len(vectors.first()["v"])
    cut = max(1, dims // 2)
    halves = [slice(0, cut), slice(cut, dims)]
    k1 = max(1, min(centroids, n_fit // LEAST_ROWS, fit_rows.select("v").distinct().count()))
    mean = np.zeros((1, dims))
    books = [fit(fit_rows, h, dims, k1) if k1 > 1 and h.start < dims else mean[:, h] for h in halves]
    opened = share_to_open(seen, halves, books, max(3, round(k * len(seen) / n)), target) if len(seen) else 1.0

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("cells")
        row = TaskContext.get().partitionId() * 7919
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["v"])
                yield pdf.assign(c1=nearest(x[:, halves[0]], books[0]), c2=nearest(x[:, halves[1]], books[1]) if books[1].size else 0, row=row + np.arange(len(pdf)))
                row += len(pdf)

    index = stored(vectors.mapInPandas(cells, "vec_id long, v array<double>, c1 int, c2 int, row long"), "index")
    queries = index.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
    held = index.groupBy("c1", "c2").agg(F.count("*").alias("n")).toPandas()  # one row a cell
    sizes[held["c1"], held["c2"]] = held["n"]
    place = dealt({c: int(m) for c, m in enumerate(sizes.sum(axis=1)) if m}, tile)
    n_blocks = -(-queries.count() // BLOCK) or 1
    enough = max(opened * n, k)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("visits")
        counts = sizes.tolist()
        filled = [(c, np.flatnonzero(sizes[c])) for c in place]
        for pdf in batches:
            if not len(pdf):
                continue
            q, out = matrix(pdf["v"]), []
            first, second = q[:, halves[0]] @ books[0].T, q[:, halves[1]] @ books[1].T
            for i, (vec_id, v, own) in enumerate(zip(pdf["vec_id"].to_numpy(), pdf["v"], pdf["own"].to_numpy(), strict=True)):
                least = least_score(first[i], second[i], counts, enough + own)
                low = least - 1e-9 * abs(least) if np.isfinite(least) else -np.inf
                tiles = {t for c, some in filled if first[i, c] + second[i, some].max() >= low for t in range(place[c][0], sum(place[c]))}
                out += [(vec_id, v, low, t) for t in sorted(tiles)]
            yield pd.DataFrame(out, columns=["query_id", "v", "least", "tile"])

    asked = queries.mapInPandas(visits, "query_id long, v array<double>, least double, tile int").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for c, t in place.items() for x in (c, t[k])]), F.col("c1"))
    tiles = index.withColumn("tile", (of(0) + F.pmod(F.xxhash64("row"), of(1))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def rerank(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        """The open cells of a tile, one product a cell."""
        if not len(qs) or not len(xs):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "n_read": np.zeros(0, np.int64)})
        xs = xs.sort_values(["c1", "c2"], kind="stable")
        x, xid, c1, c2 = matrix(xs["v"]), xs["vec_id"].to_numpy(), xs["c1"].to_numpy(), xs["c2"].to_numpy()
        edge = np.flatnonzero(np.diff(c1, prepend=-1) | np.diff(c2, prepend=-1))
        spans = list(zip(edge.tolist(), np.append(edge[1:], len(x)).tolist(), strict=True))
        out, step = [], max(1, 4_000_000 // len(x))
        for a in range(0, len(qs), step):
            q, qid, least = matrix(qs["v"].iloc[a : a + step]), qs["query_id"].to_numpy()[a : a + step], qs["least"].to_numpy()[a : a + step]
            first, second = q[:, halves[0]] @ books[0].T, q[:, halves[1]] @ books[1].T
            scores, n_read = np.full((len(q), len(x)), -np.inf), np.zeros(len(q), np.int64)
            for b, e in spans:
                i = np.flatnonzero(first[:, c1[b]] + second[:, c2[b]] >= least)
                scores[i, b:e] = q[i] @ x[b:e].T
                n_read[i] += e - b
            scores[qid[:, None] == xid] = -np.inf
            top = top_of(scores, q, x, qid, xid, k)
            first_row = ~top["query_id"].duplicated()
            out.append(top.assign(n_read=np.where(first_row, top["query_id"].map(dict(zip(qid.tolist(), n_read.tolist(), strict=True))), 0)))
        return pd.concat(out)

    keys = ["tile", "block"]
    found = asked.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double, n_read long")
    ordered = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"), F.sum("n_read").alias("n_read"))
    hits = ordered.select("query_id", "n_read", F.posexplode("best").alias("pos", "hit"))
    return hits.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"), "n_read")

"""Exact Jaccard join of word-shingle sets in their metric space (distance 1 - J, threshold 0.2).

Sets that share no shingle are at distance 1 from each other, so pivots drawn
at random say nothing about most documents (the README has figures): windows
would replicate everything everywhere. Pivots are therefore taken where
distances below 1 can be: for each shingle of the prefixes (below), the most
central document that holds it. The steps:

1. Documents of equal sets form a class; its smallest doc_id represents it.
2. A global order of shingles, rare ones first, in which two sets with J >= 0.8
   share a shingle among the first n - ceil(0.8 n) + 1 of either. Any fixed
   order does; counts are taken over the lowest SHARE of the hash range (the
   rest follow by hash, very frequent ones last), so few shingles travel.
   A shingle in one set only links nothing and is dropped where it is counted.
3. Each shingle's block gets a pivot; distances of members to their pivots are
   verified on whole texts. Members within the threshold are linked to it.
   There are no Voronoi regions: a document is in every block of its prefix.
4. Blocks whose members are not yet in one component are joined again, as a
   collection of their own: there all shingles are counted, which leaves far
   tighter places in the order. Blocks get pivots anew; then members outside a
   block's largest component meet the others by the triangle inequality: only
   if their distances to the pivot differ by at most the threshold can they
   link. Rings of that width are the join key, and one side is replicated to the
   neighbouring rings (to all, where a distance was not measured). A pair is
   taken in the block of its first common shingle, and only if the first
   shingles of both sets, up to twice a prefix, have enough in common.
5. Components of all links are found by star contraction.

Links found are exact (verified on whole texts, up to 64-bit hash collisions
inside one pair); pairs inside one component are not expanded.

Defined cases: null or empty text, or text without words, has an empty set,
n_shingles 0, and is its own component; fewer than five words are one shingle;
a null doc_id is dropped from linking and is its own (null) component; repeated
rows of one doc_id each get a row; extra columns are ignored; an empty table
gives no rows; ties of centrality go to the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posekit.llm.common import Scratch, arrow_slices, forget, hashes, hold, slices, small_batches, stored

WORDS = 5
#: Similarity threshold in percent.
PERCENT = 80
#: Part of the hash range whose shingles are counted.
SHARE = 0.35
#: A shingle in more than this part of the documents is very frequent; at most (mean set size) / HOT of them exist.
HOT = 0.005
SALTS = 64
#: Distance within which documents link.
WIDTH = 1 - PERCENT / 100
#: Rounds of star contraction, which needs about the logarithm of the largest component's size.
MAX_ROUNDS = 60
#: Frequent shingles are looked for in pieces of so many documents or shingles.
PIECE_DOCS, PIECE_SHINGLES = 5_000, 1_000_000
#: Entries of the prefixes are dealt to buckets in pieces of so many.
PIECE_ENTRIES = 700_000
#: Entries of a set's head that a row carries into the last join.
MOST_HEAD = 96
_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_CLASS1, _CLASS2 = 1 << 40, 1 << 41


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles of so many words (A-Z lower-cased): all in one array, and how many each has."""
    data = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    buf = np.frombuffer(b"\n".join([b"", *data, b""]), np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    size = np.flatnonzero(~space[:-1] & space[1:]) + 1 - start
    h = hashes(buf[~space], np.append(0, np.cumsum(size)))
    begin = np.cumsum([1, *[len(d) + 1 for d in data]])
    bounds = np.searchsorted(start, begin)  # words before each text
    n = np.diff(bounds)
    raw = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    first = np.cumsum(raw) - raw
    flat = np.empty(int(raw.sum()), np.uint64)
    if len(h) >= words:
        windows = h[: len(h) - words + 1].copy()
        for k in range(1, words):
            windows = windows * _M + h[k : len(h) - words + 1 + k]
        doc = np.repeat(np.arange(len(n)), n)
        within = doc[: len(windows)] == doc[words - 1 :]
        flat[np.repeat(n >= words, raw)] = mixed(windows[within])
    for k in np.flatnonzero((n > 0) & (n < words)).tolist():
        flat[first[k]] = mixed(np.array([hash_tuple(h[bounds[k] : bounds[k + 1]])], np.uint64))[0]
    for a, b in zip(first.tolist(), (first + raw).tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[first[raw > 0]] = True
    return flat[new], np.bincount(np.repeat(np.arange(len(n)), raw), new, len(n)).astype(np.int64)


def each_set(texts: list[str | None]) -> list[np.ndarray]:
    flat, n = shingle_sets(texts)
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def hash_tuple(h: np.ndarray) -> int:
    """A short sequence as one shingle; its length is part of it."""
    out = len(h)
    for x in h.tolist():
        out = (out * int(_M) + x + 1) & 0xFFFFFFFFFFFFFFFF
    return out


def prefix_size(n):
    """n - ceil(0.8 n) + 1."""
    return n - (PERCENT * n + 99) // 100 + 1


def limit_of(share: float) -> np.uint64:
    return np.uint64(min(int(share * 2**64), 2**64 - 1))


def surveyed(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One pass over the texts, two kinds of rows.

    A document's: doc_id, n_shingles, and two 64-bit sums f1, f2 that name its
    set. A shingle's (key not null): its 48-bit key and how often it stands in
    a piece of the input where it is frequent.
    """
    small_batches(docs.sparkSession)
    limit = limit_of(share)
    names = ["doc_id", "n_shingles", "f1", "f2", "key", "n"]

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c].astype(np.int64)) if c in columns else pa.nulls(n, pa.int64()) for c in names], names)

    def often(low: list[np.ndarray], n_docs: int) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(low), return_counts=True)
        at = n >= max(16, HOT * n_docs)
        return rows(key=key[at], n=n[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("shingles")
        low: list[np.ndarray] = []
        held = n_low = 0
        for batch in arrow_slices(batches, "text"):
            flat, n = shingle_sets(batch.column("text").to_pylist())
            at = np.repeat(np.arange(len(n)), n)
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            np.add.at(f1, at, flat * _A ^ (flat >> np.uint64(31)))
            np.add.at(f2, at, mixed(flat))
            yield rows(doc_id=batch.column("doc_id"), n_shingles=n, f1=f1, f2=f2)
            low.append(flat[flat < limit] >> np.uint64(16))
            held, n_low = held + len(n), n_low + len(low[-1])
            if held >= PIECE_DOCS or n_low >= PIECE_SHINGLES:
                yield often(low, held)
                low, held, n_low = [], 0, 0
        if low:
            yield often(low, held)

    return stored(docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names)), "surveyed")


def frequent(survey: DataFrame, n_docs: int) -> dict[int, int]:
    """Very frequent shingles (48-bit keys) with their counts.

    A bounded list: every entry stands in HOT of the documents at least.
    """
    got = survey.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1000, HOT * n_docs)).toPandas()
    return dict(zip(got["key"].tolist(), got["n"].tolist(), strict=True))


def shared_shingles(docs: DataFrame, hot: dict[int, int], n_docs: int, share: float = SHARE) -> DataFrame:
    """(doc_id, key, ord, u): shingles of the counted range that two documents hold, with their place in the order.

    Each piece of the input sends, to each of a number of hash buckets, one row
    with all its (key, document) entries there; a bucket counts its keys and
    sends back those found twice. u: how many counted shingles the document has.
    Keys of the hot list skip the buckets, as their counts are known.
    """
    bits = max(6, min(17, int(np.ceil(np.log2(max(n_docs, 1) / 128 + 1)))))
    spark, limit = docs.sparkSession, limit_of(share)
    hot_keys = np.array(sorted(hot), np.uint64)
    shared_hot = spark.sparkContext.broadcast((hot_keys, np.array([hot[int(k)] for k in hot_keys], np.int64)))
    schema = "bucket int, docs binary, places binary, keys binary"

    def packed_rows(keys: list[np.ndarray], docs_of: list[np.ndarray], used: list[np.ndarray], hot_rows: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
        """One row a bucket, and one for each document with hot shingles in its prefix."""
        rows = []
        if keys:
            key, doc, u = np.concatenate(keys), np.concatenate(docs_of), np.concatenate(used)
            bucket = (key & np.uint64((1 << bits) - 1)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, doc, u, bucket = key[order], doc[order], u[order], bucket[order]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 30))
            packed = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                rows.append((int(bucket[a]), small(doc[a:b]), small(u[a:b]), packed[a:b].tobytes()))
        for d, u, rest in hot_rows:
            packed = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((-1 - d % SALTS, small(np.full(len(rest), d, np.int64)), small(np.full(len(rest), u, np.int64)), packed.tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "docs", "places", "keys"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("shingles")
        hot_keys, hot_n = shared_hot.value
        keys, docs_of, used, hot_rows, held = [], [], [], [], 0
        for pdf in slices(batches, "text"):
            for d, s in zip(pdf["doc_id"].astype("int64"), each_set(pdf["text"].tolist()), strict=True):
                if not len(s):
                    continue
                p, u = prefix_size(len(s)), int(np.searchsorted(s, limit, side="right"))
                key = s >> np.uint64(16)
                at = np.minimum(np.searchsorted(hot_keys, key), max(len(hot_keys) - 1, 0))
                is_hot = hot_keys[at] == key if len(hot_keys) else np.zeros(len(key), bool)
                cool = key[~is_hot]
                u -= int(is_hot[:u].sum())
                take = cool[: max(u, p)]
                if len(take) < p:
                    rest = key[is_hot]
                    n = hot_n[at[is_hot]]
                    rest = rest[np.lexsort((rest, n))][: p - len(take)]
                    hot_rows.append((d, u, rest))
                keys.append(take)
                docs_of.append(np.full(len(take), d, np.int64))
                used.append(np.full(len(take), u, np.int64))
                held += len(take)
            if held >= PIECE_ENTRIES:
                yield packed_rows(keys, docs_of, used, hot_rows)
                keys, docs_of, used, hot_rows, held = [], [], [], [], 0
        yield packed_rows(keys, docs_of, used, hot_rows)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        hot_keys, hot_n = shared_hot.value
        packed = np.frombuffer(b"".join(pdf["keys"]), np.uint8).reshape(-1, 6)
        key = np.zeros((len(packed), 8), np.uint8)
        key[:, :6] = packed
        key = key.view("<u8").ravel()
        doc, u = np.concatenate([wide(x) for x in pdf["docs"]]), np.concatenate([wide(x) for x in pdf["places"]])
        if pdf["bucket"].iloc[0] < 0:
            return pd.DataFrame({"doc_id": doc, "key": key.astype(np.int64), "ord": _CLASS2 + hot_n[np.searchsorted(hot_keys, key)], "u": u})
        order = np.argsort(key, kind="stable")
        key, doc, u = key[order], doc[order], u[order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        n = np.repeat(np.diff(first, append=len(key)), np.diff(first, append=len(key)))
        twice = n >= 2
        key, doc, u, n = key[twice], doc[twice], u[twice], n[twice]
        place = np.where(key <= limit >> np.uint64(16), n, _CLASS1)
        return pd.DataFrame({"doc_id": doc, "key": key.astype(np.int64), "ord": place, "u": u})

    cells = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(emit, schema)
    return cells.groupBy("bucket").applyInPandas(count, "doc_id long, key long, ord long, u long")


def small(x: np.ndarray) -> bytes:
    """Integers in as few bytes as their range needs: width, base, differences from the base."""
    base = int(x.min()) if len(x) else 0
    d = x - base
    kind = next(k for k in ("<u1", "<u2", "<u4", "<i8") if not len(x) or int(d.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + base.to_bytes(8, "little", signed=True) + d.astype(kind).tobytes()


def wide(x: bytes) -> np.ndarray:
    kind = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[x[0]]
    return np.frombuffer(x, kind, offset=9).astype(np.int64) + int.from_bytes(x[1:9], "little", signed=True)


def ordered(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """Entries of class representatives in the global order; k: entries of the list before it, i: all entries of the set before it."""
    rows = shared.join(reps, "doc_id")
    w = Window.partitionBy("doc_id")
    rows = rows.withColumn("k", F.row_number().over(w.orderBy("ord", "key")) - 1).withColumn("s", F.sum((F.col("ord") < _CLASS1).cast("int")).over(w))
    return rows.withColumn("i", F.col("u") - F.col("s") + F.col("k")).withColumn("p", prefix_of(F.col("n_shingles")))


def prefix_of(n):
    """Column: n - ceil(0.8 n) + 1."""
    return n - F.floor((PERCENT * n + 99) / 100) + 1


def prefixes(rows: DataFrame) -> DataFrame:
    """(key, doc, n, i, lone) of the prefix entries of ordered rows."""
    return rows.where(F.col("i") < F.col("p")).select("key", F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "i", ((F.col("u") - F.col("s")) / F.greatest(F.col("u"), F.lit(1))).alias("lone"))


def heads(rows: DataFrame) -> DataFrame:
    """(doc, head, reach): the shared entries among the first `reach` of a set, in order: up to twice the prefix, MOST_HEAD entries at most."""
    reach = F.least(2 * F.col("p"), F.greatest("u", "p"), F.col("n_shingles"))  # very frequent entries are known in the prefix only
    few = rows.where((F.col("k") <= MOST_HEAD) & (F.col("i") < reach))
    held = few.groupBy(F.col("doc_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("k", "key", "i"))).alias("h"), F.max(reach).alias("reach"))
    cut = F.size("h") > MOST_HEAD
    return held.select("doc", F.transform(F.slice("h", 1, MOST_HEAD), lambda e: e["key"]).alias("head"), F.when(cut, F.get("h", F.lit(MOST_HEAD))["i"]).otherwise(F.col("reach")).alias("reach"))


def may_link(nx, ix, ny, iy):
    """Column: sizes and places allow J >= threshold if this is the first shared shingle."""
    fits = (100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny))
    return fits & ((100 + PERCENT) * F.least(nx - ix, ny - iy) >= PERCENT * (nx + ny))


def verified(pairs: DataFrame, docs: DataFrame, keep: Scratch) -> DataFrame:
    """(x, y, d, linked) of pairs (x, y) by the sets of their whole texts.

    Only the texts of documents in pairs are read on; they meet their pairs by
    two joins on doc_id, and rows come sorted by y so that its set is made once.
    """
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    texts = stored(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]), "texts")
    one = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), "x")
    both = one.join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty")), "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("shingles")
        for pdf in slices(batches, "tx"):
            new = np.append(True, pdf["y"].to_numpy()[1:] != pdf["y"].to_numpy()[:-1])  # its set is made once
            pivots, at = each_set(pdf["ty"][new].tolist()), np.cumsum(new) - 1
            out = []
            for x, y, a, k in zip(pdf["x"], pdf["y"], each_set(pdf["tx"].tolist()), at.tolist(), strict=True):
                b = pivots[k]
                both = int(len(np.intersect1d(a, b, assume_unique=True)))
                union = len(a) + len(b) - both
                out.append((x, y, 1.0 - both / union if union else 0.0, 100 * both >= PERCENT * union))
            yield pd.DataFrame(out, columns=["x", "y", "d", "linked"])

    out = keep(both.select("x", "y", "tx", "ty").mapInPandas(run, "x long, y long, d double, linked boolean"), "verified")
    forget(texts)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp) of every node of (x, y) edges; comp is the smallest node reached. Star contraction."""
    e = stored(edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(low, "a")
        held, e = e, stored(small_star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        forget(held)
        now = e.agg(F.count("*").alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not complete after {MAX_ROUNDS} rounds")
    return e.select(F.col("a").alias("doc"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("doc"), F.col("b").alias("comp")).distinct())


def star_pairs(blocks: DataFrame) -> DataFrame:
    """(x, y) of members and their block's pivot, the most central member; rows of blocks carry pivot, n and i of it."""
    return blocks.where(F.col("doc") != F.col("pivot")).where(may_link(F.col("n"), F.col("i"), F.col("pn"), F.col("pi"))).select(F.col("doc").alias("x"), F.col("pivot").alias("y")).distinct()


def with_pivot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of two members or more, each row with the block's pivot."""
    best = rows.groupBy(*keys).agg(F.count("*").alias("m"), F.min(F.struct("lone", "doc", "n", "i")).alias("p")).where(F.col("m") > 1)
    return rows.join(best, keys).select(*rows.columns, "m", F.col("p.doc").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.i").alias("pi"))


def mixed_blocks(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of blocks in several components, with comp and the block's largest component."""
    rows = rows.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("nc"), F.max_by("comp", F.struct("c", "comp")).alias("largest")).where("nc > 1")
    return rows.join(mixed.select("key", "largest"), "key")


def possible(rows: DataFrame) -> DataFrame:
    """Rows for which the sizes in their block leave room for a link."""
    least = rows.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("m")).where("m > 1")
    n, small = F.col("n"), F.greatest(F.ceil(F.col("n") * PERCENT / 100), F.col("least"))
    return rows.join(least, "key").where((100 + PERCENT) * (n - F.col("i")) >= PERCENT * (n + small)).drop("least", "m")


def links(docs: DataFrame, reps: DataFrame, hot: dict[int, int], n_docs: int) -> DataFrame:
    """(x, y): links between class representatives that span all components."""
    with Scratch() as keep:
        rows = keep(possible(prefixes(ordered(shared_shingles(docs, hot, n_docs), reps))), "prefixes")
        blocks = keep(with_pivot(rows, ["key"]), "blocks")
        found = verified(star_pairs(blocks), docs, keep).where("linked").select("x", "y")
        left = keep(mixed_blocks(rows, components(found)).select(F.col("doc").alias("doc_id")).distinct(), "left")
        # The documents left over join again, as a collection of their own with all shingles counted.
        again = keep(docs.join(left, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "again")
        n_again = left.count()
        survey = surveyed(again, 1.0)
        shared = shared_shingles(again, frequent(survey, n_again), n_again, 1.0)
        forget(survey)
        every = keep(ordered(shared, reps.join(left, "doc_id", "left_semi")), "ordered")
        rows = keep(possible(prefixes(every)), "prefixes2")
        blocks = keep(mixed_blocks(with_pivot(rows, ["key"]), components(found)).drop("comp", "largest"), "blocks2")
        star = verified(star_pairs(blocks), again, keep)
        found = keep(found.union(star.where("linked").select("x", "y")), "links")
        d = star.select(F.col("x").alias("doc"), F.col("y").alias("pivot"), "d")
        rows = blocks.join(d, ["doc", "pivot"], "left").withColumn("d", F.when(F.col("doc") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("d")))
        rows = mixed_blocks(rows, components(found))
        rest = ring_pairs(keep(rows.join(heads(every.join(rows.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")), "doc"), "rows"))
        return stored(found.union(verified(rest, again, keep).where("linked").select("x", "y")), "links")


def ring_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a block in different components and in one window of distance to its pivot; one side is outside the largest component.

    A pair is taken in the block of its first common entry only. Of the first
    entries of both sets (heads) it must share enough: what the sets hold after
    the shorter head is all that could be added.
    """
    ring = F.when(F.col("d").isNull(), F.lit(-9)).otherwise(F.floor(F.col("d") / WIDTH).cast("int"))
    side = lambda t: [F.col(c).alias(f"{a}{t}") for c, a in (("n", "n"), ("i", "i"), ("comp", "c"), ("d", "d"), ("head", "h"), ("reach", "r"))]
    x = rows.where(F.col("comp") != F.col("largest")).select("key", F.col("doc").alias("x"), *side("x"), ring.alias("ring"))
    all_rings = F.array(*[F.lit(k) for k in [-9, *range(6)]])
    near = F.when(ring == -9, all_rings).otherwise(F.array(F.lit(-9), ring - 1, ring, ring + 1))
    y = rows.select("key", F.col("doc").alias("y"), *side("y"), (F.col("comp") == F.col("largest")).alias("big"), F.explode(near).alias("ring"))
    window = F.coalesce(F.abs(F.col("dx") - F.col("dy")) <= WIDTH + 1e-9, F.lit(True))
    once = F.col("big") | (F.col("x") < F.col("y"))
    both = F.array_intersect("hx", "hy")
    first = F.coalesce(F.get(both, F.lit(0)) == x["key"], F.lit(True))
    enough = (100 + PERCENT) * (F.size(both) + F.greatest(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry"))) >= PERCENT * (F.col("nx") + F.col("ny"))
    pairs = x.join(y, [x["key"] == y["key"], x["ring"] == y["ring"], x["cx"] != y["cy"], once, window, may_link(x["nx"], x["ix"], y["ny"], y["iy"]), first & enough])
    return pairs.select("x", "y").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = surveyed(rows)
    sig = survey.where("key IS NULL").select("doc_id", "n_shingles", "f1", "f2")
    sized = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(sized.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n_shingles").alias("n_shingles"))
    n_docs = sig.count()
    comp = components(links(rows, reps, frequent(survey, n_docs), n_docs))
    member = sized.join(classes, ["n_shingles", "f1", "f2"]).select("doc_id", "rep")
    named = member.join(comp, member["rep"] == comp["doc"], "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("c"))
    return sig.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that of smallest doc_id; all columns as they were."""
    gone = near_duplicates(docs).where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

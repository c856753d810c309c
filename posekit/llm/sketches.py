"""Near duplicates by bottom-k sketches from one hash function.

A document's sketch is the k smallest hashes of its word shingles. Of the k
smallest hashes of a union every one is shared with probability J, so documents
with J >= 0.8 retain at least `least_shared(k)` common values but for a chance
below 1e-11; a set of k values or fewer is retained whole and nothing is left
to chance.

1. Documents of equal sets form a class; its smallest doc_id represents it.
2. Inverted lists of retained values. A value retained once is in no list. In a
   fixed order, rare values first, two documents that share s values share one
   among the first size - s + 1 of either: only these prefixes make lists.
3. Overlaps are generated list by list: the most central member first meets the
   others, which joins groups of near copies in as many pairs as they have
   members. A pair is taken up only if its place in both orders and both sizes
   leave room for the overlap that it needs.
4. The sketch of the union (the k smallest of both) estimates J of a pair; below
   least_shared(k) / k it goes. What is left is verified exactly on whole sets:
   in the sketches, where these are whole, else in the documents' shingle sets.
5. Documents of lists that still lie in several components are sketched anew
   with a larger k among themselves, where the order is much tighter.
6. What is still undecided then is listed by whole sets. Sketches leave room for
   pairs from a similarity of least_shared(k) / k on, and near copies between
   that and the threshold, m^2 / 2 pairs in a family of m, would all meet; whole
   sets leave room for what the threshold allows. Rows without room for any
   member of their list go first; then members meet the most central one again,
   and last all pairs of lists across components are generated and verified.
7. Components of the links by star contraction.

No list is cut and no candidate dropped; hot values (a third of all documents
may share one) are counted by partial sums, and joins on lists may be split.

Defined cases: null or empty text, or text without words, has an empty set, is
linked with nothing and kept; fewer than four words are one shingle; a null
doc_id has no component and is kept; repeated rows of one doc_id each get a row
(rows of one id with different texts link by any of them); an empty table gives
no rows; extra columns are ignored; ties of centrality go to the smaller doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posekit.llm.common import Scratch, arrow_slices, hold, small_batches, stored
from posekit.llm.jaccard import components, mixed, mixed_blocks, possible, shingle_sets, with_pivot

WORDS = 4
#: Similarity threshold in percent.
PERCENT = 80
#: Retained values of the first sketches, and of those of documents in undecided lists.
RETAINED, RETAINED_AGAIN = 64, 512
#: Chance that two documents at the threshold share fewer retained values than least_shared says.
MISS = 1e-11


def least_shared(k: int) -> int:
    """The largest t for which fewer than t of k values of a union are shared at the threshold with a chance below MISS."""
    total, t = 0.0, 0
    while t < k:
        total += math.comb(k, t) * (PERCENT / 100) ** t * (1 - PERCENT / 100) ** (k - t)
        if total >= MISS:
            break
        t += 1
    return t


def sketched(docs: DataFrame, k: int | None) -> DataFrame:
    """doc_id, n_shingles, two sums f1, f2 that name the whole set, and the sketch: the k smallest hashes (k None: all), rising, 8 bytes each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("sketches")
        for batch in arrow_slices(batches, "text"):
            flat, n = shingle_sets(batch.column("text").to_pylist(), WORDS)
            first = np.cumsum(n) - n
            at = np.repeat(np.arange(len(n)), n)
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            np.add.at(f1, at, mixed(flat))
            np.add.at(f2, at, mixed(~flat))
            low = flat[np.arange(len(flat)) - np.repeat(first, n) < k] if k else flat
            edge = np.append(0, np.cumsum(np.minimum(n, k) if k else n)) * 8
            sketch = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edge.astype("<i4").tobytes()), pa.py_buffer(low.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), sketch], ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def size(n: Column, k: int | None) -> Column:
    """Values that a set of n retains."""
    return F.least(n, F.lit(k)) if k else n


def needed(n: Column, k: int | None) -> Column:
    """Retained values that a set of n shares with any set it links with."""
    whole = F.ceil(n * PERCENT / 100)
    if not k:
        return whole
    return F.when(100 * n <= PERCENT * k, whole).otherwise(F.least(whole, F.lit(least_shared(k))))


def inverted(sketches: DataFrame, k: int | None) -> DataFrame:
    """(key, doc, n, i, lone): lists of the values in prefixes; i: values of doc before it in the order; lone: share of values retained once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<i8")
            n = batch.column("n_shingles").to_numpy()
            held = np.minimum(n, k) if k else n
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(batch.column("doc_id").to_numpy(), held)), pa.array(np.repeat(n, held))], ["key", "doc", "n"])

    rows = sketches.select("doc_id", "n_shingles", "sketch").mapInArrow(run, "key long, doc long, n long")
    often = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = rows.join(often, "key")
    one = Window.partitionBy("doc", "n")
    held = size(F.col("n"), k)
    shared = shared.withColumn("once", held - F.count("*").over(one)).withColumn("i", F.col("once") + F.row_number().over(one.orderBy("c", "key")) - 1)
    return shared.where(F.col("i") <= held - needed(F.col("n"), k)).select("key", "doc", "n", "i", (F.col("once") / held).alias("lone"))


def room(nx: Column, ix: Column, ny: Column, iy: Column, k: int | None) -> Column:
    """Column: sizes and places leave room for a link, if this is the first value that both lists hold."""
    fits = 100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny)
    whole = F.ceil(PERCENT * (nx + ny) / (100 + PERCENT))
    overlap = F.when((nx <= k) & (ny <= k), whole).otherwise(F.least(whole, F.lit(least_shared(k)))) if k else whole
    return fits & (F.least(size(nx, k) - ix, size(ny, k) - iy) >= overlap)


def shingles_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, n, shingles): the whole sets of some documents, rising, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("sketches")
        for batch in arrow_slices(batches, "text"):
            flat, n = shingle_sets(batch.column("text").to_pylist(), WORDS)
            edge = np.append(0, np.cumsum(n)) * 8
            whole = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), whole], ["doc", "n", "shingles"])

    return docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc long, n long, shingles binary")


def with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs with a binary column of x and of y; n tells rows of one id apart."""
    x = sets.select(F.col("doc").alias("x"), F.col("n").alias("nx"), F.col(column).alias("sx"))
    y = sets.select(F.col("doc").alias("y"), F.col("n").alias("ny"), F.col(column).alias("sy"))
    return pairs.join(x, ["x", "nx"]).join(y, ["y", "ny"]).select("x", "nx", "y", "ny", "sx", "sy")


def compared(pairs: DataFrame, k: int | None) -> DataFrame:
    """Pairs that can link: by the sketch of their union, or (k None) by whole sets; sure where that is exact."""
    least = least_shared(k) if k else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("sketches")
        for batch in batches:
            keep, sure = [], []
            for nx, a, ny, b in zip(batch.column("nx").to_numpy(), batch.column("sx"), batch.column("ny").to_numpy(), batch.column("sy"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                both = np.intersect1d(a, b, assume_unique=True)
                union = len(a) + len(b) - len(both)
                exact = k is None or (nx <= k and ny <= k)
                if not exact:
                    merged = np.union1d(a, b)[:k]
                    both = both[: np.searchsorted(both, merged[-1], side="right")]
                sure.append(exact)
                keep.append(100 * len(both) >= PERCENT * union if exact else len(both) >= least)
            at = pa.array(np.flatnonzero(np.array(keep, bool)))
            columns = [batch.column(c).take(at) for c in ("x", "nx", "y", "ny")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sure, pa.bool_()).take(at)], ["x", "nx", "y", "ny", "sure"])

    return pairs.mapInArrow(run, "x long, nx long, y long, ny long, sure boolean")


def verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, k: int | None, keep: Scratch) -> DataFrame:
    """(x, y) of the pairs that link."""
    sets = sketches.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sketch")
    if not k:
        return compared(with_both(pairs, sets, "sketch"), None).select("x", "y")
    near = keep(compared(with_both(pairs, sets, "sketch"), k), "estimated")
    maybe = near.where("NOT sure").drop("sure")
    ids = maybe.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    exact = compared(with_both(maybe, keep(shingles_of(docs, ids), "sets"), "shingles"), None)
    return near.where("sure").select("x", "y").union(exact.select("x", "y"))


def star_pairs(blocks: DataFrame, k: int | None) -> DataFrame:
    """Members with the most central one of their list."""
    fits = room(F.col("n"), F.col("i"), F.col("pn"), F.col("pi"), k)
    return blocks.where(F.col("doc") != F.col("pivot")).where(fits).select(F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("pivot").alias("y"), F.col("pn").alias("ny")).distinct()


def cross_pairs(rows: DataFrame, k: int | None) -> DataFrame:
    """Pairs of a list in different components; one side is outside the list's largest."""
    x = rows.where(F.col("comp") != F.col("largest")).select("key", *[F.col(c).alias(f"{c}x") for c in ("doc", "n", "i", "comp")])
    y = rows.select("key", (F.col("comp") == F.col("largest")).alias("big"), *[F.col(c).alias(f"{c}y") for c in ("doc", "n", "i", "comp")])
    once = F.col("big") | (F.col("docx") < F.col("docy"))
    fits = room(F.col("nx"), F.col("ix"), F.col("ny"), F.col("iy"), k)
    both = x.join(y, [x["key"] == y["key"], F.col("compx") != F.col("compy"), once, fits])
    return both.select(F.col("docx").alias("x"), "nx", F.col("docy").alias("y"), "ny").distinct()


def links(docs: DataFrame, sketches: DataFrame, first: int, again: int) -> DataFrame:
    """(x, y): links between class representatives that span all components."""
    own = ("key", "doc", "n", "i", "lone")
    with Scratch() as keep:
        blocks = keep(with_pivot(inverted(sketches, first), ["key"]), "lists")
        found = keep(verified(star_pairs(blocks, first), sketches, docs, first, keep), "links")
        left = keep(mixed_blocks(blocks.select(*own), components(found)).select(F.col("doc").alias("doc_id")).distinct(), "undecided")
        texts = keep(docs.join(left, "doc_id", "left_semi"), "texts")
        longer = keep(sketched(texts, again), "sketches")
        blocks = keep(with_pivot(inverted(longer, again), ["key"]), "lists")
        found = keep(found.union(verified(star_pairs(blocks, again), longer, texts, again, keep)), "links")
        left = keep(mixed_blocks(blocks.select(*own), components(found)).select(F.col("doc").alias("doc_id")).distinct(), "undecided")
        whole = keep(sketched(texts.join(left, "doc_id", "left_semi"), None), "whole")
        blocks = keep(with_pivot(possible(inverted(whole, None)), ["key"]), "lists")
        found = keep(found.union(verified(star_pairs(blocks, None), whole, texts, None, keep)), "links")
        rows = keep(mixed_blocks(blocks.select(*own), components(found)), "across")
        return stored(found.union(verified(cross_pairs(rows, None), whole, texts, None, keep)), "links")


def near_duplicates(docs: DataFrame, first: int = RETAINED, again: int = RETAINED_AGAIN) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = stored(sketched(rows, first), "sketches")
    sized = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    names = ["n_shingles", "f1", "f2"]
    classes = stored(sized.groupBy(*names).agg(F.min("doc_id").alias("rep")), "classes")
    member = sized.select("doc_id", *names).join(classes, names).select("doc_id", "rep")
    reps = stored(sized.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *names], "left_semi").dropDuplicates(["doc_id", *names]), "reps")
    comp = components(links(rows, reps, first, again))
    named = member.join(comp, member["rep"] == comp["doc"], "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("c"))
    out = every.select("doc_id", "n_shingles").join(named, "doc_id", "left").withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

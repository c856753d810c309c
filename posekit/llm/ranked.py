"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

build() reads each document once. A shard is what one task reads, a row of
segments of bounded size. In a segment documents are numbered by rising length,
so a block of 64 postings holds documents of like length, and the largest count
with the shortest length of the block is a tight bound of what any of them can
score. Postings are differences and counts as bytes of seven bits.

search() sends to each shard the postings of the asked terms and the items, in
blocks of bounded size. In a shard, per item and window of documents:

1. Terms are put in order of their global bound (over the segment). Those whose
   bounds together stay below the k-th best score so far are not essential.
2. Documents of the essential lists are scored; the other lists follow, from the
   greatest bound down. A document goes as soon as its score, the bound of its
   block in the list and the bounds of the lists after it stay below the k-th
   best: before that block is decompressed.
3. The heap of an item goes on through the segments of its shard; shard heaps
   are merged by one window with a limit.

Scores are integers and bounds are exact, so the result is that of scoring all
documents; terms are known by 64-bit hashes.

Defined cases: null or empty text holds no term, is in no list and does not
count in N; a null doc_id is no document; repeated rows rank one by one; an
item with null text has no rows, an item row that repeats counts once; ties go
to the smaller doc_id; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posekit.llm.common import arrow_slices, give_back, hold, small_batches, stored, word_table

#: Postings of a block; a segment ends at so many terms or documents; documents are scored in windows of so many.
BLOCK = 64
SEGMENT_TERMS, SEGMENT_DOCS = 2_000_000, 65_536
WINDOW = 2048
#: Rows (item, term) of the items that a shard searches at a time.
ITEM_TERMS = 50_000
#: Bytes of terms: digits, letters, and all of the characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
INDEX = "shard int, segment int, term long, n long, terms long, first binary, most binary, stop binary, data binary"
#: Postings that were decompressed, for tests.
DECODED = [0]


def impact(tf, m):
    """What one occurrence list adds for a weight of 1."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def pressed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the last of each marked; and where each begins and all end."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    edge = np.append(0, np.cumsum(size))
    out = np.empty(int(edge[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        at = size > k
        out[edge[:-1][at] + k] = (values[at] >> 7 * k & 127) | np.where(size[at] == k + 1, 128, 0)
    return out, edge


def unpressed(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data & 128) + 1
    starts = np.append(0, ends[:-1])
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=0))):
        at = starts + k < ends
        out[at] |= (data[starts[at] + k] & 127).astype(np.int64) << 7 * k
    return out


def binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Slices of an array as binary values."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])


def segment(shard: int, number: int, ids: np.ndarray, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Index rows of one segment: one of the documents (term null), one a term."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    by_length = np.argsort(lengths, kind="stable")
    ordinal = np.empty(len(ids), np.int64)
    ordinal[by_length] = np.arange(len(ids))

    def batch(size: int, **columns: pa.Array) -> pa.RecordBatch:
        columns |= {"shard": pa.array(np.full(size, shard, np.int32)), "segment": pa.array(np.full(size, number, np.int32))}
        kinds = {c.split()[0]: {"long": pa.int64(), "binary": pa.binary()}.get(c.split()[1]) for c in INDEX.split(", ")}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, kinds[c]) for c in names], names)

    whole = np.array([0, len(ids)])
    counts = {"n": pa.array([int((lengths > 0).sum())]), "terms": pa.array([int(lengths.sum())])}
    yield batch(1, **counts, first=binaries(lengths[by_length].astype("<i8"), whole), data=binaries(ids[by_length].astype("<i8"), whole))
    if not len(term):
        return
    place = ordinal[doc]
    by = np.lexsort((place, term))
    term, place = term[by], place[by]
    new_term = np.append(True, term[1:] != term[:-1])
    at = np.flatnonzero(new_term | np.append(True, place[1:] != place[:-1]))
    tf = np.diff(np.append(at, len(term)))
    term, place = term[at], place[at]
    t = np.flatnonzero(new_term[at])
    n = np.diff(np.append(t, len(term)))
    within = np.arange(len(term)) - np.repeat(t, n)
    b = np.flatnonzero(within % BLOCK == 0)
    size = np.diff(np.append(b, len(term)))
    gap = np.append(0, np.diff(place))
    gap[b] = 0
    start = np.repeat(b, size)
    values = np.empty(2 * len(term), np.int64)
    values[np.arange(len(term)) + start] = gap
    values[np.arange(len(term)) + start + np.repeat(size, size)] = tf - 1
    data, edge = pressed(values)
    block_edge = np.append(np.searchsorted(b, t), len(b))
    term_edge = edge[2 * np.append(t, len(term))]
    stop = edge[2 * np.append(b[1:], len(term))] - np.repeat(term_edge[:-1], np.diff(block_edge))
    most = np.maximum.reduceat(tf, b)
    yield batch(len(t), term=pa.array(term[t].view(np.int64)), n=pa.array(n), first=binaries(place[b].astype("<i4"), block_edge), most=binaries(most.astype("<i4"), block_edge), stop=binaries(stop.astype("<i4"), block_edge), data=binaries(data, term_edge))


def terms_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of a batch's texts, and where those of each begin."""
    return word_table([(t or b"").lower() for t in batch.column("text").cast(pa.binary()).to_pylist()], LETTERS)


def build(docs: DataFrame) -> DataFrame:
    """The index of all documents, written to the shared folder: see INDEX."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("ranked")
        shard, number, held, n_terms, n_docs = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, lengths, term = (np.concatenate([x[k] for x in held]) for k in range(3))
            yield from segment(shard, number, ids, lengths, term, np.repeat(np.arange(len(ids)), lengths))

        for batch in arrow_slices(batches, "text"):
            term, bounds = terms_of(batch)
            held.append((batch.column("doc_id").to_numpy(), np.diff(bounds), term))
            n_terms, n_docs = n_terms + len(term), n_docs + batch.num_rows
            if n_terms >= SEGMENT_TERMS or n_docs >= SEGMENT_DOCS:
                yield from flush()
                number, held, n_terms, n_docs = number + 1, [], 0, 0
                give_back()
        if held:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return stored(rows.mapInArrow(run, INDEX), "index")


class Segment:
    """Postings of the asked terms in one segment."""

    def __init__(self, lengths: np.ndarray, ids: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        self.m = 75 + 25 * lengths * n_docs // n_terms
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = {}
        self.known: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, term: int, n: int, first: bytes, most: bytes, stop: bytes, data: bytes) -> None:
        first_of = np.frombuffer(first, "<i4")
        bound = impact(np.frombuffer(most, "<i4").astype(np.int64), self.m[first_of])
        self.lists[term] = (first_of, bound, np.frombuffer(stop, "<i4"), np.frombuffer(data, np.uint8), n)

    def blocks(self, term: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts in blocks a to b - 1 of a list, decompressed once."""
        if (term, a, b) not in self.known:
            first, _, stop, data, n = self.lists[term]
            values = unpressed(data[stop[a - 1] if a else 0 : stop[b - 1]])
            size = np.full(b - a, BLOCK)
            if b == len(first):
                size[-1] = n - BLOCK * (b - 1)
            begin = np.repeat(np.cumsum(size) - size, size)
            at = np.arange(len(begin)) + begin
            gap = np.cumsum(values[at])
            head = np.cumsum(size) - size
            place = gap - np.repeat(gap[head], size) + np.repeat(first[a:b], size)
            DECODED[0] += len(place)
            self.known[term, a, b] = place, impact(values[at + np.repeat(size, size)] + 1, self.m[place])
        return self.known[term, a, b]

    def search(self, asked: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of those so far and this segment's documents. asked: terms and their weights."""
        lists = sorted((w * int(self.lists[t][1].max()), t, w) for t, w in asked if t in self.lists)
        bound = np.cumsum([x[0] for x in lists])
        for low in range(0, len(self.ids) if lists else 0, WINDOW):
            high = min(low + WINDOW, len(self.ids))
            least = int(scores[-1]) if len(scores) == k else 1
            rest = int(np.searchsorted(bound, least, side="left"))  # lists before it are not essential
            total = np.zeros(high - low, np.int64)
            for _, t, w in lists[rest:]:
                first = self.lists[t][0]
                a, b = max(0, int(np.searchsorted(first, low, side="right")) - 1), int(np.searchsorted(first, high))
                if a < b:
                    place, worth = self.blocks(t, a, b)
                    x, y = np.searchsorted(place, (low, high))
                    total[place[x:y] - low] += w * worth[x:y]
            at = np.flatnonzero(total)
            for r in range(rest - 1, -1, -1):
                at = at[total[at] + bound[r] >= least]
                if not len(at):
                    break
                _, t, w = lists[r]
                first, most = self.lists[t][:2]
                b = np.searchsorted(first, at + low, side="right") - 1
                after = bound[r - 1] if r else 0
                can = total[at] + np.where(b >= 0, w * most[b], 0) + after >= least
                at, b = at[can], b[can]
                for x in np.unique(b[b >= 0]).tolist():
                    place, worth = self.blocks(t, x, x + 1)
                    mine = at[b == x]
                    y = np.minimum(np.searchsorted(place, mine + low), len(place) - 1)
                    total[mine] += np.where(place[y] == mine + low, w * worth[y], 0)
            at = at[total[at] >= least]
            if len(at):
                scores, ids = np.append(scores, total[at]), np.append(ids, self.ids[at + low])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
        return scores, ids


def search_shard(rows: pa.Table, n_docs: int, n_terms: int, k: int) -> pa.Table:
    """Heaps of a block of items over one shard."""
    hold("ranked")
    asked: dict[tuple[int | None, int], list[tuple[int, int]]] = {}
    parts: dict[int, list[dict]] = {}
    docs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows.to_pylist():
        if r["items"] is not None:
            for x in r["items"]:
                asked.setdefault((x["item_id"], x["version"]), []).append((x["term"], x["weight"]))
        elif r["term"] is None:
            docs[r["segment"]] = np.frombuffer(r["first"], "<i8"), np.frombuffer(r["data"], "<i8")
        else:
            parts.setdefault(r["segment"], []).append(r)
    heap = dict.fromkeys(asked, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    for number, lists in sorted(parts.items()):
        s = Segment(*docs[number], n_docs, n_terms)
        for r in lists:
            s.add(r["term"], r["n"], r["first"], r["most"], r["stop"], r["data"])
        for item, terms in asked.items():
            heap[item] = s.search(terms, *heap[item], k)
    out = [(i, v, d, s) for (i, v), (scores, ids) in heap.items() for s, d in zip(scores.tolist(), ids.tolist(), strict=True)]
    return pa.table([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], names=["item_id", "version", "doc_id", "score"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, version, term, times) of every distinct item; version tells texts of one item_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text"):
            term, bounds = terms_of(batch)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            by = np.lexsort((term, row))
            term, row = term[by], row[by]
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1]))[: len(term)])
            of = pa.array(row[first])
            columns = [batch.column("item_id").take(of), batch.column("version").take(of), pa.array(term[first].view(np.int64)), pa.array(np.diff(np.append(first, len(term))))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "version", "term", "times"])

    rows = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("version"), "text").distinct()
    return rows.mapInArrow(run, "item_id long, version long, term long, times long")


def each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = index.sparkSession
    parts = index.where("term IS NULL")
    n_docs, n_terms, last = parts.agg(F.sum("n"), F.sum("terms"), F.max("shard")).first()
    names = ["item_id", "version", "doc_id", "score"]
    if not n_terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    lists = index.where("term IS NOT NULL")
    asked = stored(item_terms(items), "asked")
    held = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1)))
    n_blocks = -(-asked.count() // ITEM_TERMS) or 1
    block = F.pmod(F.xxhash64("item_id", "version"), F.lit(n_blocks)).cast("int")
    asked = stored(asked.join(held, "term").select(block.alias("block"), "item_id", "version", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"), "weighted")
    structs = F.collect_list(F.struct("item_id", "version", "term", "weight"))
    requests = asked.groupBy("block").agg(structs.alias("items")).select("block", "items", each(last + 1).alias("shard"))
    rows = (
        lists.join(asked.select("block", "term").distinct(), "term")
        .unionByName(parts.withColumn("block", each(n_blocks)))
        .unionByName(requests, allowMissingColumns=True)
    )
    heaps = rows.groupBy("shard", "block").applyInArrow(lambda t: search_shard(t, n_docs, n_terms, k), ", ".join(f"{c} long" for c in names))
    best = Window.partitionBy("item_id", "version").orderBy(F.desc("score"), "doc_id")
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

"""Cost-balanced packing of documents into token sequences.

A sequence's cost is the sum over its pieces of LINEAR * n + QUADRATIC * n^2
(attention inside a piece). Full pieces of CAPACITY ids fill sequences of their
own; the rest of a group, longest first, goes to the sequence of lowest cost
that still has room for it whole, and is cut only where none has. A group's
capacities add up to its ids exactly: full sequences, then one for each set bit
of what is left, as powers of two need no padding. So nothing is padded.

A group is a run of documents as they are read, up to GROUP_IDS ids, so packing
moves no text and no ids between machines. Sequence ids are unique: partition
and counter.

Defined cases: null or empty text is the end id alone; equal lengths keep
reading order, equal costs take the first sequence; repeated rows are packed
each; an empty table gives no rows; extra columns are ignored; a null doc_id is
packed under a null id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posekit.llm.common import arrow_slices, small_batches
from posekit.llm.wordcache import encoder, with_end

CAPACITY = 4096
LINEAR = 1.0
QUADRATIC = 1.0 / 2048
GROUP_IDS = 8_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, capacity: int = CAPACITY) -> np.ndarray:
    """Full sequences, then powers of two for what is left."""
    rest = total % capacity
    return np.array([capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a group."""
    out: list[tuple[int, int, int, int, int]] = []
    room = capacities(int(lengths.sum()), capacity)
    used = np.zeros(len(room), np.int64)
    cost = np.zeros(len(room))
    seq = 0
    rest = []
    for d, n in enumerate(lengths.tolist()):
        full = n // capacity
        out += [(d, k * capacity, capacity, seq + k, 0) for k in range(full)]
        room[seq : seq + full] = 0
        seq += full
        if n % capacity:
            rest.append((n % capacity, d, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    room, used, cost = room[seq:], used[seq:], cost[seq:]
    for n, d, start in rest:
        while n:
            fits = room >= n
            if fits.any():
                s, part = int(np.argmin(np.where(fits, cost, np.inf))), n
            else:
                s = int(np.argmax(room))
                part = int(room[s])
            out.append((d, start, part, seq + s, int(used[s])))
            room[s] -= part
            used[s] += part
            cost[s] += LINEAR * part + QUADRATIC * part * part
            n, start = n - part, start + part
    return out


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece. path: a tokenizer file that drops white space; end_id closes every document."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        base = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = done = 0

        def flush() -> pa.RecordBatch:
            names, lengths = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
            ids = np.concatenate([x[2] for x in held])
            first = np.cumsum(lengths) - lengths
            d, start, n, seq, offset = (np.array(x, np.int64) for x in zip(*assign(lengths, capacity), strict=True))
            at = first[d] + start
            crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at.tolist(), (at + n).tolist(), strict=True)]
            columns = [names.take(pa.array(d)), *map(pa.array, (start, n, np.array(crc, np.int64), lengths[d], base + done + seq, offset))]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in arrow_slices(batches, "text"):
            flat, sizes = with_end(*enc.ids(batch.column("text").to_pylist()), end_id)
            held.append((batch.column("doc_id"), sizes, flat))
            size += len(flat)
            if size >= GROUP_IDS:
                out = flush()
                yield out
                done += int(pc.max(out.column("sequence_id")).as_py()) - base - done + 1
                held, size = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

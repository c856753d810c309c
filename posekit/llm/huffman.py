"""Token ids in files of canonical length-limited Huffman code.

Texts become ids once (a table in the shared folder), and are counted over the
whole corpus in the same pass; code lengths come from those counts by package-merge with at most
MAX_BITS bits, and documents in ascending doc_id order are written as
independent blocks of whole documents. A block holds its documents' ids and
lengths, the code bits, and the bit offset of every STEP-th id; decoding starts
at all of those offsets together and is driven by one table of 2^MAX_BITS
entries.

Format (Parquet rows): part, block int; base long (ids of the part before the
block); doc_ids binary (int64, a null id is the smallest int64); n_ids binary
(int32 a document); bits binary (big-endian bit order); offsets binary (int64
bit offsets). The code itself is one row of canonical lengths (uint8 an id).

Defined cases: null or empty text is the end id alone; repeated rows are kept,
ordered by length and content; ids outside
the vocabulary raise; an empty table gives no rows; extra columns are ignored; one
very long document makes one long block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posekit.llm.common import arrow_slices, hold, new_path, small_batches, stored
from posekit.llm.wordcache import encoder, with_end

MAX_BITS = 16
STEP = 256
BLOCK_IDS = 1 << 19
VOCABULARY = 50_257
NULL_ID = -(1 << 63)
TOKEN_SCHEMA = "doc_id long, n_tokens int, ids binary, crc long, row long, counts binary"
BLOCK_SCHEMA = "part int, block int, base long, first_doc long, n long, doc_ids binary, n_ids binary, bits binary, offsets binary"


def tokenized(docs: DataFrame, path: str, end_id: int, drops_space: bool = False, vocabulary: int = VOCABULARY) -> DataFrame:
    """One pass over the texts, two kinds of rows.

    A document's: doc_id, n_tokens, ids (uint16), and crc and row, which order
    equal doc_ids. A task's (counts not null): how often each id stands in what
    the task has read, as (id int32, n int64) arrays one behind the other.
    """
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in TOKEN_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, drops_space)
        part, row, total = TaskContext.get().partitionId(), 0, np.zeros(vocabulary, np.int64)
        for batch in arrow_slices(batches, "text"):
            flat, sizes = with_end(*enc.ids(batch.column("text").to_pylist()), end_id)
            total += counted(flat, vocabulary)
            ends = np.cumsum(sizes)
            data = flat.tobytes()
            crc = np.fromiter((zlib.crc32(data[2 * (b - n) : 2 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)), np.int64, len(sizes))
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(data)])
            rows = (part << 33) + row + np.arange(len(sizes))
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), ids, pa.array(crc), pa.array(rows), pa.nulls(len(sizes), pa.binary())], names)
        at = np.flatnonzero(total)
        if len(at):
            count = at.astype("<i4").tobytes() + total[at].astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([None, None, None, None, None, count], [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKEN_SCHEMA)


def counted(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    out = np.bincount(ids, minlength=vocabulary)
    if len(out) > vocabulary:
        raise ValueError(f"id {len(out) - 1} is outside the vocabulary of {vocabulary}")
    return out


def id_counts(tokens: DataFrame, vocabulary: int = VOCABULARY) -> np.ndarray:
    """Counts of all ids over all documents, from the tasks' counts; at most one row an id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                k = len(x) // 12
                total[np.frombuffer(x, "<i4", k)] += np.frombuffer(x, "<i8", k, 4 * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    got = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[got["id"].to_numpy(int)] = got["n"].to_numpy(np.int64)
    return out


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Package-merge: the best code lengths of at most max_bits; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    is_leaf, level = [], leaves
    for _ in range(max_bits):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        is_leaf.append(rank < len(leaves))  # of the next list
        level = both[rank]
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in is_leaf[-2::-1]:
        chosen = int(leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    depth[: min(take, len(leaves))] += 1  # the first list has leaves only
    out[order] = depth
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """id and length by the next max_bits bits."""
    symbol, size = np.zeros(1 << max_bits, np.int32), np.ones(1 << max_bits, np.int64)
    codes = canonical(lengths)
    for i in np.flatnonzero(lengths):
        n = int(lengths[i])
        a = int(codes[i]) << (max_bits - n)
        symbol[a : a + (1 << (max_bits - n))] = i
        size[a : a + (1 << (max_bits - n))] = n
    return symbol, size


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
    """Code bits of the ids, and the bit offsets of every step-th one."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    if not len(ids):
        return b"", b""
    word, shift = at >> 5, (64 - size - (at & 31)).astype(np.uint64)
    value = codes[ids] << shift
    words = np.zeros(int(word[-1]) + 2, np.uint32)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), first)
    words[word[first] + 1] |= np.bitwise_or.reduceat((value & np.uint64(0xFFFFFFFF)).astype(np.uint32), first)
    n_bytes = (int(at[-1] + size[-1]) + 7) // 8
    return words.astype(">u4").tobytes()[:n_bytes], at[::step].tobytes()


def unpack_bits(bits: bytes, offsets: bytes, n: int, table: tuple[np.ndarray, np.ndarray], step: int = STEP, max_bits: int = MAX_BITS) -> np.ndarray:
    """The n ids of a block, all checkpoints stepping together."""
    buf = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    at = np.frombuffer(offsets, np.int64).copy()
    out = np.zeros((len(at), step), np.int32)
    symbol, size = table
    last, limit = n - (len(at) - 1) * step, len(buf) - 4
    for k in range(min(step, n)):
        if k == last and len(at) > 0:
            at = at[:-1]  # the last run of ids is shorter
        byte = np.minimum(at >> 3, limit)
        window = ((buf[byte] << 16) | (buf[byte + 1] << 8) | buf[byte + 2]) >> (24 - max_bits - (at & 7)) & ((1 << max_bits) - 1)
        out[: len(at), k] = symbol[window]
        at = at + size[window]
    return out.reshape(-1)[:n]


def write_blocks(tokens: DataFrame, lengths: np.ndarray, path: str) -> DataFrame:
    """Documents in ascending doc_id order as blocks at path. Rows of one doc_id are dealt out by length, crc and row."""
    codes = canonical(lengths)
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("blocks")
        part, block, base = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            """Full blocks of what is held, and at the end the rest."""
            nonlocal block, base, held, size
            docs, n, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            ends, a = np.cumsum(n), 0
            while a < len(docs):
                done = int(ends[a - 1]) if a else 0
                b = min(int(np.searchsorted(ends, done + BLOCK_IDS)) + 1, len(docs))
                if not last and int(ends[b - 1]) - done < BLOCK_IDS:
                    break
                some = ids[done : int(ends[b - 1])]
                bits, offsets = pack_bits(some, codes, lengths)
                row = [part, block, base, int(docs[a]), len(some), docs[a:b].tobytes(), n[a:b].astype(np.int32).tobytes(), bits, offsets]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 4], strict=True)], names)
                block, base, a = block + 1, base + len(some), b
            held = [(docs[a:], n[a:], ids[int(ends[a - 1]) if a else 0 :])]
            size = len(held[0][2])

        for batch in batches:
            ids = batch.column("ids").cast(pa.large_binary())
            at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 2 if len(ids) else np.zeros(1, np.int64)
            flat = np.frombuffer(ids.buffers()[2] or b"", np.uint16)[at[0] : at[-1]].copy()
            held.append((batch.column("doc_id").fill_null(NULL_ID).to_numpy(), np.diff(at), flat))
            size += len(flat)
            if size >= BLOCK_IDS:
                yield from blocks(False)
        if size:
            yield from blocks(True)

    order = ["doc_id", "n_tokens", "crc", "row"]
    ordered = tokens.where("counts IS NULL").select(*order, "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)
    return tokens.sparkSession.read.schema(BLOCK_SCHEMA).parquet(path)


def read_blocks(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) by decoding every block.

    Where a part starts comes from the parts' totals: one number a part, as
    many as the write had tasks, is all that passes the driver.
    """
    parts = blocks.groupBy("part").agg(F.min("first_doc").alias("first"), F.sum("n").alias("n"), F.min("block").alias("b")).collect()
    before, total = {}, 0
    for p in sorted(parts, key=lambda r: (r["first"], r["part"])):
        before[p["part"]] = total
        total += p["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("decoding")
        table = decode_table(lengths)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                docs, sizes = np.frombuffer(r.doc_ids, np.int64), np.frombuffer(r.n_ids, np.int32).astype(np.int64)
                ids = unpack_bits(r.bits, r.offsets, int(r.n), table).astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends, sizes, strict=True)]
                yield pd.DataFrame({"doc_id": pd.Series(docs, dtype="Int64").mask(docs == NULL_ID), "start": before[r.part] + r.base + ends - sizes, "n_tokens": sizes, "ids_crc32": crc})

    return blocks.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def roundtrip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write all documents in the format, read the files back."""
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, path, end_id), "ids")
    lengths = code_lengths(id_counts(tokens))
    blocks = write_blocks(tokens, lengths, new_path(spark, "huffman"))
    return read_blocks(blocks, lengths)

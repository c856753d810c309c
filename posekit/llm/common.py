"""Helpers shared by the corpus operators: shared-folder tables and word rules."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DEFAULT_SHARED = "file:///tmp/posekit-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else our own default (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or DEFAULT_SHARED).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/posekit/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of ours through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that texts reach Python workers in: by bytes, as one text may be long (a setting of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back (survives lost executors)."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing is computed from it any more."""
    drop_path(df.sparkSession, df._stored_at)


class Scratch:
    """Tables written on the way to a result; all are deleted at the end of the with block."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(stored(df, name))
        return self.held[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for df in self.held:
            forget(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() cuts at exactly those six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(text: str) -> str:
    """A-Z to a-z, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def slices(batches: Iterator[pd.DataFrame], column: str, max_chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches so that one piece holds about max_chars of text (one row at least)."""
    for pdf in batches:
        size = pdf[column].str.len().fillna(0).to_numpy().cumsum() if len(pdf) else []
        start = 0
        while start < len(pdf):
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(size.searchsorted(done + max_chars, side="right")))
            yield pdf.iloc[start:stop]
            start = stop
    give_back()


#: Odd numbers for polynomial hashes modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


#: Bytes hashed at a time.
HASH_BYTES = 1 << 18


def hashes(data: np.ndarray, offsets: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """64-bit hash of each piece (not empty) of the bytes between offsets: a polynomial in the position within the piece, mixed."""
    size = np.diff(offsets)
    if not len(size):
        return np.zeros(0, np.uint64)
    powers = np.full(int(size.max()), base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    out, a = np.empty(len(size), np.uint64), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + HASH_BYTES, side="right")) - 1)
        first = offsets[a:b] - offsets[a]
        at = np.arange(offsets[b] - offsets[a]) - np.repeat(first, size[a:b])
        out[a:b] = np.add.reduceat((data[offsets[a] : offsets[b]].astype(np.uint64) + np.uint64(1)) * powers[at], first)
        a = b
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


def word_table(data: list[bytes], letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where those of each text begin (and end).

    letters: which of the 256 bytes make up words; by default all but the six white spaces.
    """
    buf = np.frombuffer(b"\n".join([b"", *data, b""]), np.uint8)
    space = ~letters[buf] if letters is not None else (buf == 32) | ((buf >= 9) & (buf <= 13))
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    size = np.flatnonzero(~space[:-1] & space[1:]) + 1 - start
    begin = np.cumsum([1, *[len(d) + 1 for d in data]])
    return hashes(buf[~space], np.append(0, np.cumsum(size))), np.searchsorted(start, begin)


_HELD: dict[str, Callable[[], object]] = {}


def hold(name: str, release: Callable[[], object] = lambda: None) -> None:
    """A Python worker lives through many stages; it keeps the tables of one operator at a time.

    Every operator calls this first in its tasks; the others' tables are then
    released, and freed memory goes back to the machine.
    """
    if name not in _HELD:
        while _HELD:
            _HELD.popitem()[1]()
        _HELD[name] = release
        give_back()


def give_back() -> None:
    """Return freed memory to the machine; a worker may idle while the JVM works."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def arrow_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about max_bytes of text (one row at least)."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(size.searchsorted(done + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def strip_spaces(c):
    """Column: white space of the contracts stripped at both ends."""
    return F.regexp_replace(c, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")

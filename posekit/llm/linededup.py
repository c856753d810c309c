"""Line dedup over levelled sorted runs of line hashes.

A store keeps, for every long line key, 128 bits of hash, the number of
documents that hold it and the largest such doc_id. It is a list of levels; each
level is a list of runs; a run is a Parquet table bucketed and sorted by hash, so
that a batch dealt by the same hash meets it in a merge join without moving it.
Batches come in descending doc_id order. A new batch is aggregated and
anti-joined with the runs: hashes that no run holds are added with their owner,
hashes already held only bring their counts (their owner, in an earlier batch, is
the larger id). When a level has FANOUT runs, they are merged into one run of the
next level. The number of batches grows with the corpus. After the
last batch the runs are merged once more, keys below the document threshold fall
away, and the remaining verdicts drop lines.

Defined cases: null or empty text is one empty line; lines whose key is shorter
than MIN_CHARS are never dropped; equal lines inside one document count as one
document; documents with equal ids count as one; ties cannot arise as ids order
all holders; null ids take no part and keep all lines; an empty table gives no
rows; extra columns pass through untouched, except that columns named n_lines or
n_dropped are replaced by the results.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posekit.llm.common import drop_path, new_path, stored

MIN_CHARS = 40
MIN_DOCS = 5
#: Up to so many documents come in MIN_BATCHES batches; every doubling beyond adds one.
BATCH_DOCS = 1_000_000
MIN_BATCHES = 4
FANOUT = 3
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters beyond A-Z that lower() would change.
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]"
_RUN = "h1 long, h2 long, n_docs long, owner long"


def line_key(line):
    """Column: the key of a line; white space stripped, A-Z lower-cased and nothing else."""
    key = F.btrim(line, F.lit(SPACES))
    return F.when(key.rlike(OTHER_UPPER), F.translate(key, UPPER, LOWER)).otherwise(F.lower(key))


def key_hashes(key):
    """Columns h1, h2."""
    return F.xxhash64(key), F.xxhash64(F.lit(7), key, F.lit("#"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2) of the long lines; hashed at the scan, so no text is shuffled."""
    lines = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", line_key(F.col("line")).alias("key"))
    h1, h2 = key_hashes("key")
    return keys.where(F.length("key") >= min_chars).select("doc_id", h1.alias("h1"), h2.alias("h2"))


class LineRuns:
    """The levelled store. add() takes one batch of (doc_id, h1, h2)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.root = new_path(spark, "runs")
        self.name = f"posekit_run_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made = 0

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows as the buckets are: joins and groupings by hash move nothing from here on."""
        return rows.repartition(self.buckets, "h1", "h2")

    def _write(self, run: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd").option("path", f"{self.root}/{table}").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _union(self, tables: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], _RUN)
        for t in tables:
            out = out.union(self.spark.table(t))
        return out

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        drop_path(self.spark, f"{self.root}/{table}")

    def merged(self, tables: list[str]) -> DataFrame:
        """Runs as one: the counts of a hash summed; its owner is the largest holder."""
        return self._dealt(self._union(tables)).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))

    def add(self, keys: DataFrame) -> None:
        own = self._dealt(keys.distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner")))
        new = own.select("h1", "h2")
        for t in self.runs():
            new = new.join(self.spark.table(t).where(F.col("owner").isNotNull()).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        marked = own.join(new.withColumn("new", F.lit(True)).hint("merge"), ["h1", "h2"], "left")
        self._write(marked.select("h1", "h2", "n_docs", F.when(F.col("new"), F.col("owner")).alias("owner")), 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                self._write(self.merged(full), level + 1)
                for t in full:
                    self._drop(t)
            level += 1

    def verdicts(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(h1, h2, owner) of the keys found in min_docs documents or more."""
        return self.merged(self.runs()).where(F.col("n_docs") >= min_docs).select("h1", "h2", "owner")

    def close(self) -> None:
        for t in self.runs():
            self._drop(t)
        self.levels = []


def batches(docs: DataFrame, n_docs: int = BATCH_DOCS, least: int = MIN_BATCHES) -> list[DataFrame]:
    """Ranges of doc_id, the highest first; bounds come from one pass over the ids."""
    got = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.approx_count_distinct("doc_id").alias("n")).first()
    if got["lo"] is None:
        return []
    n = least + max(0, math.ceil(math.log2(got["n"] / n_docs)))
    lo, hi = got["lo"], got["hi"]
    edges = [lo + (hi - lo + 1) * k // n for k in range(n + 1)]
    return [docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)) for a, b in zip(edges[-2::-1], edges[:0:-1], strict=True) if b > a]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """All columns of docs, text replaced by the kept lines, plus n_lines and n_dropped (long).

    Dropped keys of a document reach it as one set of hashes, so that a
    document's lines are filtered by one pass over its own text.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*columns)
    keys = stored(line_keys(docs.select("doc_id", "text"), min_chars), "linekeys")
    store = LineRuns(spark)
    for batch in batches(keys, batch_docs):
        store.add(batch)
    verdicts = stored(store.verdicts(min_docs), "verdicts")
    store.close()
    tag = uuid.uuid4().hex
    own_id, gone = f"id_{tag}", f"gone_{tag}"
    hit = keys.join(verdicts, ["h1", "h2"]).where(F.col("doc_id") < F.col("owner"))
    drops = hit.groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    joined = docs.join(drops, F.col("doc_id") == F.col(own_id), "left")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)

    def stays(line):
        key = line_key(line)
        h1, h2 = key_hashes(key)
        return ~((F.length(line) >= min_chars) & (F.length(key) >= min_chars) & F.array_contains(F.col(gone), F.struct(h1.alias("h1"), h2.alias("h2"))))

    none = F.col(gone).isNull()
    kept = F.when(~none, F.filter(lines, stays))
    out = joined.withColumns({f"all_{tag}": lines, f"kept_{tag}": kept})
    dropped = F.when(none, F.lit(0)).otherwise(F.size(f"all_{tag}") - F.size(f"kept_{tag}"))
    text = F.when(none, F.col("text")).otherwise(F.array_join(f"kept_{tag}", "\n"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in columns], F.size(f"all_{tag}").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))

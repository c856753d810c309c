"""Quality rules with host-level verdicts.

Each document is measured on its whole text. Failures of the base rules are
aggregated by host, the failure rate of a host is shrunk towards the corpus by
an empirical beta prior (method of moments over the hosts), and the verdict on
the host is joined back to its documents.

Defined cases: null or empty text has no words and fails the base rule; a null
host gives no host verdict (the document keeps its own); hosts with equal
figures get equal verdicts; no documents give no rows; repeated rows count
each; columns beyond the named ones are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posekit.llm.common import SPACES, arrow_slices, hold, small_batches, stored, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6
#: A hot host is spread over this many join keys.
SALTS = 32
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_BITS = 21


def repeat_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that is found twice or more, the first one included."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    pair = code[:-2] * len(ids) + code[1:-1]
    if len(ids) >= 1 << _BITS:  # three ids no longer fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * len(ids) + code[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def failed(n_words, n_repeat_words):
    """The base rule, for Columns and for plain numbers alike."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a document: id, host, the five figures, base_failed."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    kept = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality")
        names = [x.split()[0] for x in METRICS.split(", ")]
        for batch in arrow_slices(batches, "text"):
            got = np.array([measure(t) for t in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *map(pa.array, got.T.copy())], ["doc_id", "host", *names])

    kind = {f.name: f.dataType.simpleString() for f in kept}
    out = rows.mapInArrow(run, f"doc_id {kind['doc_id']}, host {kind['host']}, {METRICS}")
    return out.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk by the empirical beta prior.

    With mean m and variance v of the hosts' rates, the prior's strength is
    m(1-m)/v - 1, held to 1 at least; without spread it is taken as 1e6, so
    that all hosts get the corpus rate.
    """
    parts = measured.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")
    )
    rate = F.col("f") / F.col("n")
    prior = parts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    strength = F.when(F.col("v") > 1e-12, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(F.lit(1e6))
    return (
        parts.join(F.broadcast(prior), how="inner")  # one row, always
        .withColumn("strength", strength)
        .select("host", "n", "f", ((F.col("f") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("host_rate"))
    )


def judged(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Join the hosts' verdicts back; a host's documents are spread over SALTS keys."""
    measured = stored(measured, "quality")
    hosts = host_rates(measured).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(hosts.select("host", "salt", "host_rate"), ["host", "salt"], "left")
    host_failed = F.coalesce(F.col("host_rate") > max_rate, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~host_failed).drop("salt")


def filter_documents(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their own columns; a null doc_id is judged like any other.

    A text is measured again where it is read, which is cheaper than moving the
    figures to it. Base failures go there; only the rejected hosts (known after
    the aggregate) are joined, by host and salt, never the texts by id.
    """
    measured = stored(metrics(docs), "quality")
    tag = uuid.uuid4().hex
    host, salt = f"host_{tag}", f"salt_{tag}"
    bad = stored(host_rates(measured).where(F.col("host_rate") > MAX_HOST_RATE).select(F.col("host").alias(host), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt)), "hosts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("quality")
        for batch in arrow_slices(batches, "text"):
            got = [measure(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([not failed(x[0], x[4]) for x in got], pa.bool_()))

    passed = docs.mapInArrow(run, docs.schema).withColumn(f"own_{tag}", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return passed.join(bad, (passed[f"own_{tag}"] == bad[salt]) & (passed["source"] == bad[host]), "left_anti").select(*docs.columns)

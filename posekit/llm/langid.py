"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations, by the forward
algorithm; a text's log-likelihood is the sum over its words, and the answer is
the language of largest likelihood (posterior under equal priors as score).

Training is expectation-maximisation: words of labelled documents are counted
by language, expected piece counts come from forward-backward over each
distinct word, and are summed across tasks. It uses a bounded sample of
TRAIN_DOCS documents a language, drawn by hash; the model has (languages x
vocabulary) numbers. Words are runs of letters in lower case after the space
mark; a word longer than MAX_WORD letters is scored in parts. Characters
without a piece are spelled in bytes. Words too improbable for plain doubles
are summed in log space.

Defined cases: null text, empty text and text without a letter are `und` with
score 0, as is everything where no labelled document exists; ties go to the
language first in order; a null doc_id is not held out; repeated rows each get
a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posekit.llm.common import arrow_slices, hold, slices, small_batches, stored
from posekit.llm.pieces import SPACE, Lattices, Pieces, pieces

#: Labelled documents a language that the model is fitted on, about.
TRAIN_DOCS = 2_000
ROUNDS = 3
SMOOTHING = 0.05
MAX_WORD = 32
#: Words of a smaller probability go through log space; above it, what underflows on the way is no share of the sum.
LEAST = 1e-250
#: Distinct words whose scores a worker keeps (about 200 bytes each).
MAX_KEPT = 250_000
#: Bytes of text whose words are looked up together.
SLICE = 1_000_000
#: Words whose lattices are built together.
BATCH_WORDS = 1_000
_SCORES: dict[str, WordScores] = {}
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Letter runs in lower case, long ones in parts."""
    found = LETTERS.findall(text.lower()) if text else []
    if found and max(map(len, found)) > MAX_WORD:
        found = [w[k : k + MAX_WORD] for w in found for k in range(0, len(w), MAX_WORD)]
    return found


def edge_probabilities(lat: Lattices, prob: np.ndarray) -> np.ndarray:
    """Probability by language of each edge; a character spelled in bytes has the product of theirs."""
    p = prob[lat.ids]
    for k, spelled in lat.spelling.items():
        p[k] = np.prod(prob[spelled], axis=0)
    return p


def forward(lat: Lattices, p: np.ndarray) -> np.ndarray:
    """alpha[node, language]: the sum over segmentations of what precedes the node."""
    alpha = np.zeros((int(lat.size.sum()) + len(lat.words), p.shape[1]))
    alpha[lat.first] = 1.0
    for span in lat.steps():
        end = lat.end[span]
        group = np.flatnonzero(np.diff(end, prepend=-1))
        alpha[end[group]] = np.add.reduceat(alpha[lat.start[span]] * p[span], group)
    return alpha


def edge_logs(lat: Lattices, prob: np.ndarray) -> np.ndarray:
    """The logarithms of edge_probabilities."""
    with np.errstate(divide="ignore"):
        logs = np.log(prob)
    p = logs[lat.ids]
    for k, spelled in lat.spelling.items():
        p[k] = logs[spelled].sum(axis=0)
    return p


def log_forward(lat: Lattices, p: np.ndarray) -> np.ndarray:
    """The logarithm of forward(), from logarithms of edges."""
    alpha = np.full((int(lat.size.sum()) + len(lat.words), p.shape[1]), -np.inf)
    alpha[lat.first] = 0.0
    for span in lat.steps():
        end = lat.end[span]
        group = np.flatnonzero(np.diff(end, prepend=-1))
        x = alpha[lat.start[span]] + p[span]
        top = np.maximum.reduceat(x, group)
        top[np.isneginf(top)] = 0.0
        with np.errstate(divide="ignore"):
            alpha[end[group]] = np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(group, append=len(end)), axis=0)), group)) + top
    return alpha


def word_logs(vocab: Pieces, batch: list[str], prob: np.ndarray) -> np.ndarray:
    """Log-probability (word, language)."""
    lat = vocab.lattices([SPACE + w for w in batch])
    total = forward(lat, edge_probabilities(lat, prob))[lat.last]
    low = np.flatnonzero((total < LEAST).any(axis=1))
    total[low] = 1.0
    out = np.log(total)
    if len(low):
        lat = vocab.lattices([SPACE + batch[k] for k in low.tolist()])
        out[low] = log_forward(lat, edge_logs(lat, prob))[lat.last]
    return out


def expected_counts(vocab: Pieces, batch: list[str], n: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected count of each piece over the words, each counted n times (one language)."""
    lat = vocab.lattices([SPACE + w for w in batch])
    p = edge_probabilities(lat, prob[:, None])
    alpha, p = forward(lat, p)[:, 0], p[:, 0]
    beta = np.zeros_like(alpha)
    beta[lat.last] = 1.0
    for span in lat.steps(backward=True):
        np.add.at(beta, lat.start[span], p[span] * beta[lat.end[span]])
    low = np.flatnonzero(alpha[lat.last] < LEAST)
    total, n_plain = alpha[lat.last], n.copy()
    total[low], n_plain[low] = 1.0, 0.0
    out = piece_sums(vocab, lat, alpha[lat.start] * p * beta[lat.end] * (n_plain / total)[lat.word])
    return out + log_expected_counts(vocab, [batch[k] for k in low.tolist()], n[low], prob) if len(low) else out


def log_expected_counts(vocab: Pieces, batch: list[str], n: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """expected_counts() in log space."""
    lat = vocab.lattices([SPACE + w for w in batch])
    p = edge_logs(lat, prob[:, None])
    alpha, p = log_forward(lat, p)[:, 0], p[:, 0]
    beta = np.full_like(alpha, -np.inf)
    beta[lat.last] = 0.0
    for span in lat.steps(backward=True):
        np.logaddexp.at(beta, lat.start[span], p[span] + beta[lat.end[span]])
    total = alpha[lat.last]
    total = np.where(np.isneginf(total), 0.0, total)  # a word without any segmentation has no counts
    return piece_sums(vocab, lat, np.exp(alpha[lat.start] + p + beta[lat.end] - total[lat.word]) * n[lat.word])


def piece_sums(vocab: Pieces, lat: Lattices, weight: np.ndarray) -> np.ndarray:
    """Weights of edges summed by piece; a character spelled in bytes counts each of them."""
    out = np.bincount(np.maximum(lat.ids, 0), np.where(lat.ids < 0, 0.0, weight), minlength=vocab.size)
    for k in np.flatnonzero(lat.ids < 0).tolist():
        for i in lat.spelling[k]:
            out[i] += weight[k]
    return out


def uniform(vocab: Pieces) -> np.ndarray:
    out = np.zeros(vocab.size)
    usable = list(vocab.ids.values()) + vocab.bytes
    out[usable] = 1.0 / len(usable)
    return out


def held_out():
    """Column: crc32 of doc_id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, path: str, per_language: int = TRAIN_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and (vocabulary, languages) piece probabilities, from text and non-null lang."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, 0))
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(11)), F.lit(1 << 24)) / (1 << 24)
    sample = labelled.where(draw < share).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("labelled words")
        for pdf in slices(batches, "text"):
            by: dict[str, Counter] = {}
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                by.setdefault(lang, Counter()).update(words(text))
            yield pd.DataFrame([(g, w, n) for g, c in by.items() for w, n in c.items()], columns=["lang", "word", "n"])

    counts = stored(sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    vocab = pieces(path)
    prob = np.repeat(uniform(vocab)[:, None], len(languages), axis=1)
    for _ in range(rounds):
        model = prob

        def expect(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            hold("expected counts")
            vocab, total = pieces(path), np.zeros((len(languages), model.shape[0]))
            for pdf in batches:
                for lang, part in pdf.groupby("lang"):
                    k = languages.index(lang)
                    for a in range(0, len(part), BATCH_WORDS):
                        some = part.iloc[a : a + BATCH_WORDS]
                        total[k] += expected_counts(vocab, some["word"].tolist(), some["n"].to_numpy(float), model[:, k])
            k, i = np.nonzero(total)
            yield pd.DataFrame({"k": k, "i": i, "n": total[k, i]})

        got = counts.mapInPandas(expect, "k int, i int, n double").groupBy("k", "i").agg(F.sum("n").alias("n")).toPandas()  # languages x vocabulary
        new = np.zeros_like(prob)
        new[got["i"], got["k"]] = got["n"]
        new = np.where(uniform(vocab)[:, None] > 0, new + SMOOTHING, 0.0)
        prob = new / new.sum(axis=0)
    return languages, prob


class WordScores:
    """Log-probability by language of words, each distinct word scored once and kept."""

    def __init__(self, path: str, prob: np.ndarray):
        self.vocab, self.prob = pieces(path), prob
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, prob.shape[1]))

    def rows(self, every: list[str]) -> np.ndarray:
        new = list(set(every).difference(self.index))
        if len(self.index) + len(new) > MAX_KEPT:
            self.index, self.table, new = {}, self.table[:0], list(set(every))
        if new:
            new.sort(key=len)
            parts = [self.table]
            for a in range(0, len(new), BATCH_WORDS):
                some = new[a : a + BATCH_WORDS]
                parts.append(word_logs(self.vocab, some, self.prob))
            self.table = np.concatenate(parts)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        return self.table[np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood (text, language) and number of words."""
        per = [words(t) for t in texts]
        n = np.fromiter(map(len, per), np.int64, len(per))
        out = np.zeros((len(per), self.prob.shape[1]))
        some = np.flatnonzero(n)
        if len(some):
            rows = self.rows([w for x in per for w in x])
            out[some] = np.add.reduceat(rows, (np.cumsum(n) - n)[some])
        return out, n


def predicted(texts: list[str | None], name: str, languages: list[str], prob: np.ndarray, path: str) -> list[tuple[str, float]]:
    """(language, posterior) of each text; a worker keeps the word scores of the model of that name."""
    if not languages:
        return [("und", 0.0)] * len(texts)
    hold(f"words of {name}", _SCORES.clear)
    if name not in _SCORES:
        _SCORES[name] = WordScores(path, prob)
    ll, n = _SCORES[name].texts(texts)
    best = ll.argmax(axis=1)
    top = ll[np.arange(len(ll)), best]
    score = 1.0 / np.exp(np.maximum(ll - top[:, None], -700)).sum(axis=1)
    return [(languages[b], float(s)) if k else ("und", 0.0) for b, s, k in zip(best, score, n, strict=True)]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; only text is looked at."""
    languages, prob = model
    shared, name = docs.sparkSession.sparkContext.broadcast(prob), uuid.uuid4().hex
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text", SLICE):
            got = predicted(batch.column("text").to_pylist(), name, languages, shared.value, path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, least: float = 0.5) -> DataFrame:
    """Documents in a known language with posterior of at least `least`, with their own columns."""
    languages, prob = model
    shared, name = docs.sparkSession.sparkContext.broadcast(prob), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text", SLICE):
            got = predicted(batch.column("text").to_pylist(), name, languages, shared.value, path)
            yield batch.filter(pa.array([g != "und" and s >= least for g, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, path: str) -> DataFrame:
    """Train on what is not held out, predict every document."""
    return predict(docs, train(docs.where(~held_out()), path), path)

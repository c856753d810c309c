"""Runs of repeated words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("posekit.llm")
from posekit.llm import runs  # noqa: E402


def brute(w):
    """(start, length, period): every period tried at every place."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda x: (x[0], x[2]))


def row(doc_id, text, tails=False):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if tails and doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), s, n, q, 1000 * n // q if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def random_words(rng):
    w = [rng.randint(1, rng.choice([1, 2, 2, 3, 10])) for _ in range(rng.randint(0, 70))]
    if rng.random() < 0.5 and w:
        a = rng.randrange(len(w))
        p = 1 + (len(w) - a) // rng.randint(2, 9)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w + w[: rng.randint(0, len(w))] + w if rng.random() < 0.3 else w


def numbers(w):
    return np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        got = runs.runs_of(numbers([x for t in texts for x in t]), np.cumsum([0, *map(len, texts)]))
        assert [got.get(k, []) for k in range(len(texts))] == [brute(t) for t in texts]


def test_hostile_texts_stay_cheap():
    """One word over and over, a phrase after ever new words, Fibonacci words: no pair of equal left words is touched."""
    n = 60_000
    assert runs.runs_of(numbers([1] * n), np.array([0, n])) == {0: [(0, n, 1)]}
    phrase = [x for k in range(n // 8) for x in [100 + 2 * k, 1, 2, 3, 4, 5, 6, 101 + 2 * k]]
    assert runs.runs_of(numbers(phrase), np.array([0, len(phrase)])) == {}
    a, b = [1], [1, 2]
    while len(b) < 1500:
        a, b = b, b + a
    assert runs.runs_of(numbers(b), np.array([0, len(b)]))[0] == brute(b)


def test_suffix_levels_and_prefixes():
    w = numbers([1, 2, 1, 2, 1, 3, 1, 2, 1])
    levels = runs.suffix_levels(w, np.full(len(w), len(w)))
    assert len(set(levels[-1].tolist())) == len(w)
    a, b = np.array([0, 0, 1, 2]), np.array([2, 6, 7, 8])
    assert runs.common_prefix(levels, a, b).tolist() == [3, 3, 2, 1]


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    texts = {k: rng.choice([" ", "\n", "\t \x0b"]).join(f"é{x}" for x in random_words(rng)) for k in range(200)}
    texts |= {300: None, 301: "", 302: " \n ", 303: "a " * 500, 304: "one two three"}
    df = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "doc_id long, text string, n_runs int")
    for tails in (False, True):
        got = {r["doc_id"]: tuple(r) for r in runs.detect(df, runs.with_tails if tails else runs.no_tails).collect()}
        assert got == {k: row(k, t, tails) for k, t in texts.items()}


def test_rows_that_repeat_and_none(spark):
    df = spark.createDataFrame([(1, "a b " * 9), (1, "a b " * 9), (None, "a b " * 9)], "doc_id long, text string")
    got = sorted((tuple(r) for r in runs.detect(df, runs.with_tails).collect()), key=str)
    assert got == sorted([row(1, "a b " * 9), row(1, "a b " * 9), row(None, "a b " * 9)], key=str)
    assert runs.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_the_table(spark):
    from posekit.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    short = {k for k, t in texts.items() if len((t or "").split()) < 1200}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_word_runs"](spark, d).collect()}
    assert got.keys() == texts.keys() and len(short) > 150
    assert all(got[k] == row(k, texts[k], True) for k in short)

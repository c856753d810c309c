"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("posekit.llm")
from posekit.llm import ranked  # noqa: E402
from posekit.llm.common import lower_ascii  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lower_ascii(text or ""))


def brute(docs, items, k=20):
    """docs: (doc_id, text) rows; items: {item_id: text}."""
    held = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for i, text in items.items():
        scored = []
        for d, c, size in held:
            m = 75 + 25 * size * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, d))
        out |= {(i, r + 1): (d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return out


def run(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    rows = ranked.search(ranked.build(d), q, k).collect()
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}
    assert len(got) == len(rows)
    return got


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "Of", "é1", "ÉA", "x-y", *[f"w{k}" for k in range(300)]]
    weights = [400 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 100, 600])))) for k in range(n)]
    items = {k: " ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for k in range(40)}
    return docs, items


def test_segments_against_brute_force(spark, monkeypatch):
    """Small blocks, windows and segments: heaps go on, lists fall away, ties at the last place count."""
    docs, items = corpus(0, 700)
    docs += [(1000 + k, docs[5][1]) for k in range(40)]  # copies: equal scores
    heap = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in items}
    monkeypatch.setattr(ranked, "WINDOW", 64)
    word = [[t.encode() for t in terms(x)] for _, x in docs]
    n, total = sum(map(bool, word)), sum(map(len, word))
    hashed = {t: int(ranked.word_table([t], ranked.LETTERS)[0][0]) for w in word for t in w}
    df = Counter(t for w in word for t in set(w))
    for a in range(0, len(docs), 150):
        part = word[a : a + 150]
        term, doc = np.array([hashed[t] for w in part for t in w], np.uint64), np.repeat(np.arange(len(part)), list(map(len, part)))
        ids, lengths = np.array([d for d, _ in docs[a : a + 150]]), np.array(list(map(len, part)))
        rows = [r for b in ranked.segment(0, a, ids, lengths, term, doc) for r in b.to_pylist()]
        s = ranked.Segment(np.frombuffer(rows[0]["first"], "<i8"), np.frombuffer(rows[0]["data"], "<i8"), n, total)
        for r in rows[1:]:
            s.add(r["term"] & (1 << 64) - 1, r["n"], r["first"], r["most"], r["stop"], r["data"])
        for i, text in items.items():
            asked = [(hashed[t], q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t, q in Counter(x.encode() for x in terms(text)).items() if t in hashed]
            heap[i] = s.search([x for x in asked if x[1] > 0], *heap[i], 20)
    got = {(i, r + 1): x for i, (scores, ids) in heap.items() for r, x in enumerate(zip(ids.tolist(), scores.tolist(), strict=True))}
    assert got == brute(docs, items)


def test_blocks_are_left_packed():
    """A rare term decides; the long list of a common one is hardly decompressed."""
    n = 60_000
    lengths = np.full(n, 50)
    rare = np.arange(0, n, 3000)
    term = np.append(np.full(n, 1, np.uint64), np.full(len(rare) * 5, 2, np.uint64))
    doc = np.append(np.arange(n), np.repeat(rare, 5))
    by = np.argsort(doc, kind="stable")
    rows = [r for b in ranked.segment(0, 0, np.arange(n), lengths, term[by], doc[by]) for r in b.to_pylist()]
    s = ranked.Segment(np.frombuffer(rows[0]["first"], "<i8"), np.frombuffer(rows[0]["data"], "<i8"), n, int(lengths.sum()))
    for r in rows[1:]:
        s.add(r["term"], r["n"], r["first"], r["most"], r["stop"], r["data"])
    ranked.DECODED[0] = 0
    scores, ids = s.search([(1, 1), (2, 9000)], np.zeros(0, np.int64), np.zeros(0, np.int64), 3)
    assert ids.tolist() == rare[:3].tolist() and ranked.DECODED[0] < n / 4


def test_search_against_brute_force(spark, monkeypatch):
    docs, items = corpus(1, 400)
    docs += [(500, None), (501, ""), (502, "... !!"), (503, "long " * 5000 + "w1"), (None, "w1 w2 w3")]
    items |= {90: None, 91: "", 92: "nowhere", 93: "w1 w1 W1 long"}
    rows = [*items.items(), (0, items[0])]  # repeated
    assert run(spark, docs, rows) == brute(docs, items)
    monkeypatch.setattr(ranked, "ITEM_TERMS", 100)  # many blocks of items
    assert run(spark, docs, rows, 3) == brute(docs, items, 3)


def test_bytes_of_seven_bits():
    v = np.array([0, 1, 127, 128, 16383, 16384, 1 << 30])
    data, edge = ranked.pressed(v)
    assert ranked.unpressed(data).tolist() == v.tolist() and edge.tolist() == [0, 1, 2, 3, 5, 7, 10, 15]


def test_repeated_rows_and_empty_tables(spark):
    got = run(spark, [(1, "a b"), (1, "a b"), (2, "c")], [(7, "a")])
    assert [(k, v[0]) for k, v in sorted(got.items())] == [((7, 1), 1), ((7, 2), 1)]
    assert run(spark, [], [(7, "a")]) == {} and run(spark, [(1, None)], [(7, "a")]) == {} and run(spark, [(1, "a")], []) == {}

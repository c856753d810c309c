"""Near duplicates by bottom-k sketches against all pairs."""

import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("posekit.llm")
from posekit.llm import sketches  # noqa: E402
from posekit.llm.common import lower_ascii  # noqa: E402


def brute(texts, words=4):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t or ""))
        sets[d] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def run(spark, texts, **kw):
    df = spark.createDataFrame([(d, t, True) for d, t in texts.items()], "doc_id long, text string, kept boolean")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in sketches.near_duplicates(df, **kw).collect()}


def corpus(seed, n, size=150):
    """Near copies at many distances, chains, shared passages, exact copies, odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    bases = [[word() for _ in range(rng.randint(5, size))] for _ in range(6)]
    passage = [word() for _ in range(60)]
    texts = {0: None, 1: "", 2: "  \n", 3: "one two", 4: "One TWO", 5: "two one", 6: "É a b c d e"}
    chain = bases[0][:]
    for d in range(7, n):
        kind = rng.random()
        if kind < 0.5:
            rate = rng.choice([0, 0.005, 0.02, 0.05])
            w = [word() if rng.random() < rate else x for x in rng.choice(bases)]
        elif kind < 0.65:
            chain = [word() if rng.random() < 0.015 else x for x in chain]
            w = chain[:]
        elif kind < 0.85:
            w = passage + [word() for _ in range(rng.randint(0, 80))]
        else:
            w = [word() for _ in range(rng.randint(1, 60))]
        texts[d] = " ".join(w)
    return texts


@pytest.mark.parametrize("seed, size", [(0, 150), (1, 900)])
def test_components_against_all_pairs(spark, seed, size):
    """Sets below and above the number of retained values."""
    texts = corpus(seed, 350, size)
    assert run(spark, texts) == brute(texts)


def test_sketches_stay_sketches(spark):
    """Sets of more values than even the second sketches retain are estimated first, then verified."""
    texts = corpus(3, 200, 700)
    assert run(spark, texts, first=32, again=64) == brute(texts)


def test_least_shared():
    for k in (32, 64, 512):
        t = sketches.least_shared(k)
        below = sum(math.comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(t))
        assert below < 1e-11 <= below + math.comb(k, t) * 0.8**t * 0.2 ** (k - t)
    rng = np.random.default_rng(0)  # sketches of pairs at the threshold
    for _ in range(300):
        u = rng.integers(0, 1 << 62, 1000)
        x, y = np.sort(u[:900])[:64], np.sort(np.append(u[:800], u[900:]))[:64]
        assert len(np.intersect1d(x, y)) >= sketches.least_shared(64)


def test_threshold_is_exact(spark):
    a = " ".join(f"w{k}" for k in range(12))  # nine shingles
    texts = {1: a, 2: a + " x", 3: a + " x y z", 4: " ".join(f"w{k}" for k in range(11)), 9: a.upper()}
    assert run(spark, texts) == brute(texts)


def test_near_copies_below_the_threshold_do_not_all_meet(spark, monkeypatch):
    """A family without its original, of more values than sketches retain: its pairs are at 0.7 to 0.8, where sketches alone leave room."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 9999)}"
    base = [word() for _ in range(800)]
    near = base[:]
    for k in range(0, 800, 25):
        near[k] = word()
    family = {d: " ".join(word() if rng.random() < 0.04 else w for w in base) for d in range(40)}
    texts = family | {40: " ".join(near), 41: " ".join([*near, "x"]), 42: " ".join(base[:700]), 43: " ".join(base[:640])}
    made, plain = [], sketches.cross_pairs
    monkeypatch.setattr(sketches, "cross_pairs", lambda rows, k: made.append(plain(rows, k)) or made[-1].persist())
    got = run(spark, texts)
    assert got == brute(texts)
    assert len({c for _, c, _ in got.values()}) > 30
    assert sum(pairs.count() for pairs in made) <= len(texts)


def test_empty_and_repeated_rows(spark):
    assert sketches.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (0, "A b c d e"), (None, "a b c d e")], "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in sketches.near_duplicates(df).collect())
    assert got == [(-1, 2, None, True), (0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False)]
    two = spark.createDataFrame([(5, "a b c d e"), (5, "p q r s t"), (7, "a b c d e"), (8, "p q r s t")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in sketches.near_duplicates(two).collect()} == {(5, 5), (7, 5), (8, 5)}

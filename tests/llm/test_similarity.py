"""Jaccard join, nearest neighbours and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from posekit.llm import jaccard, multiindex  # noqa: E402
from posekit.llm.common import lower_ascii  # noqa: E402


def sets(texts):
    out = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t or ""))
        out[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(texts):
    s = sets(texts)
    parent = {d: d for d in s}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d)) for d in s}


def run(spark, texts):
    df = spark.createDataFrame([(d, t, "clash") for d, t in texts.items()], "doc_id long, text string, component_id string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}


def corpus(seed, n):
    """Near copies at many distances, without their base, chains, shared passages, exact copies, odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    bases = [[word() for _ in range(rng.randint(5, 120))] for _ in range(6)]
    passage = [word() for _ in range(60)]
    texts = {0: None, 1: "", 2: "  \n", 3: "one two", 4: "One TWO", 5: "two one", 6: "É a b c d e"}
    chain = bases[0][:]
    for d in range(7, n):
        kind = rng.random()
        if kind < 0.5:
            w = [word() if rng.random() < rng.choice([0, 0.005, 0.02, 0.05]) else x for x in rng.choice(bases)]
        elif kind < 0.65:
            chain = [word() if rng.random() < 0.015 else x for x in chain]
            w = chain[:]
        elif kind < 0.85:
            w = passage + [word() for _ in range(rng.randint(0, 80))]
        else:
            w = [word() for _ in range(rng.randint(1, 60))]
        texts[d] = " ".join(w)
    return texts


@pytest.mark.parametrize("seed", [0, 1])
def test_components_against_all_pairs(spark, seed):
    texts = corpus(seed, 350)
    assert run(spark, texts) == brute(texts)


def test_passages_in_many_documents(spark):
    """Every shingle stands in many documents, few of which link."""
    rng = random.Random(4)
    passages = [[f"p{k}w{j}" for j in range(rng.randint(10, 40))] for k in range(12)]
    texts = {}
    for d in range(160):
        w = [x for k in sorted(rng.sample(range(12), 9)) for x in passages[k]]
        texts[d] = " ".join(w if d % 3 else [x if rng.random() > 0.01 else "new" for x in w])
    want = brute(texts)
    assert run(spark, texts) == want and 10 < len({c for _, c in want.values()}) < 150


def test_very_frequent_shingles_take_the_other_way(spark, monkeypatch):
    texts = corpus(2, 250)
    want = brute(texts)
    monkeypatch.setattr(jaccard, "frequent", lambda survey, n: _hot(texts))
    assert run(spark, texts) == want


def _hot(texts):
    count = {}
    for t in texts.values():
        for k in (jaccard.each_set([t])[0] >> np.uint64(16)).tolist():
            count[k] = count.get(k, 0) + 1
    return {k: n for k, n in count.items() if n >= 10}


def test_threshold_is_exact(spark):
    a = " ".join(f"w{k}" for k in range(13))  # nine shingles
    texts = {1: a, 2: a + " x", 3: a + " x y z", 4: " ".join(f"w{k}" for k in range(12))}
    assert run(spark, texts) == brute(texts)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (0, "A b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect())
    assert got == [(-1, 2, None), (0, 2, 0), (1, 2, 0), (1, 2, 0)]


def test_star_contraction(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (30, 3)], "x long, y long")
    got = {r["doc"]: r["comp"] for r in jaccard.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 7: 7, 8: 7, 9: 7}


# Nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def nearest(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if v is not None and len(v) == 6 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            scored = sorted((-float((x * y).sum()), i) for i, y in ok if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist(), 0, 0.0) for k in range(1500)]
    rows[20] = (20, [5 * x for x in rows[20][1]], 0, 0.0)
    rows += [(2000 + k, rows[20][1], 0, 0.0) for k in range(30)]  # copies: ties go to the smaller id
    rows += [(3000, None, 0, 0.0), (3020, [0.0] * 6, 0, 0.0), (3040, [1.0, None] * 3, 0, 0.0), (3060, [float("nan")] * 6, 0, 0.0), (3080, [1.0], 0, 0.0)]
    got = {}
    for r in multiindex.search(vectors(spark, rows), "vec_id % 20 = 0", 20, centroids=8, sample_rows=300, tile=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = nearest(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    assert [i for i, _ in got[20]][:20] == list(range(2000, 2020))


def test_the_index_prunes(spark):
    """Vectors around 150 directions: few rows are read, and no more tasks than tiles hold them."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 24))
    x = (centres[rng.integers(0, 150, 6000)] + rng.normal(size=(6000, 24)) * 0.6).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist(), 0, 0.0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int, score double")
    rows = multiindex.search(df, "vec_id % 20 = 0", 20, sample_rows=3000, tile=700).toPandas()
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    got = rows.sort_values(["query_id", "rank"])["vec_id"].to_numpy().reshape(300, 20)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got, want, strict=True)]) >= 0.9
    assert rows.drop_duplicates("query_id")["n_read"].mean() <= 0.2 * 6000


def test_tiles():
    got = multiindex.dealt({0: 3, 1: 5, 2: 25, 3: 4, 4: 10, 5: 1}, 10)
    assert got == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 4: (5, 1), 5: (6, 1)}


def test_repeated_ids_and_ties_of_length(spark):
    rows = [(0, [1.0, 2.0], 0, 0.0), (0, [3.0, 1.0], 0, 0.0), (1, [1.0, 1.0], 0, 0.0), (1, [1.0, 1.0], 0, 0.0), (2, [5.0, 5.0, 5.0], 0, 0.0), (3, [5.0, 5.0, 5.0], 0, 0.0), (4, [5.0, 5.0, 5.0], 0, 0.0), (6, [5.0] * 3, 0, 0.0)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in multiindex.search(vectors(spark, rows), "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 3.0)]


def test_few_vectors(spark):
    rows = [(0, [1.0] * 6, 0, 0.0), (20, [2.0] * 6, 0, 0.0), (21, [1.0] * 6, 0, 0.0)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in multiindex.search(vectors(spark, rows), "vec_id % 20 = 0").collect())
    assert got == [(0, 1, 20, 12.0), (0, 2, 21, 6.0), (20, 1, 0, 12.0), (20, 2, 21, 12.0)]
    assert multiindex.search(vectors(spark, []), "vec_id % 20 = 0").count() == 0


def test_pairs_come_in_falling_order():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    pairs = list(multiindex.best_pairs(a, b))
    got = [a[i] + b[j] for i, j, _ in pairs]
    assert len({p[:2] for p in pairs}) == len(got) == 35 and np.allclose(got, [p[2] for p in pairs]) and np.allclose(got, np.sort((a[:, None] + b).ravel())[::-1])


# Pipeline


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, d)
        assert out.columns == docs.columns, name
        assert out.count() <= kept.count()
        kept = out.cache()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts and all(c == i for i, (_, c) in brute(texts).items())  # no near copies are left
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, d)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(texts)


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0

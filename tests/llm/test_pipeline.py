"""The whole pipeline against plain Python, on documents of every kind."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from posekit.llm import langid, quality  # noqa: E402
from posekit.llm.pieces import SPACE, pieces  # noqa: E402
from tests.llm.test_similarity import brute  # noqa: E402
from tests.llm.test_text_operators import brute_lines, brute_repeat  # noqa: E402

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, salt int, _bad string, d array<long>"


def fixture(spark):
    """Documents of sf0.001 with hostile ones among them; extra columns have the names of the stages' own."""
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    prose = [r for r in rows if len((r[1] or "").split()) > 120]
    first = max(r[0] for r in rows) + 1
    line = "This passage of more than forty characters stands in many documents."
    more = [None, "", " \n\t", "ሀ" * 40, "x" * 5000, "12 34 " * 100, " ".join(["same words here"] * 80)]
    for k in range(8):
        words = prose[k][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        more += [prose[k][1], " ".join(words), prose[k + 10][1] + "\n" + line, prose[k + 20][1].upper()]
    more.append("\n".join([prose[1][1]] * 2 + [prose[2][1], "ሀ" * 64, "Zusätzlich <|endoftext|> fin"] * 30))  # long
    rows += [(first + k, t, None, "mixed") for k, t in enumerate(more)]
    rows += [(first + 500 + k, " ".join(f"w{j}" for j in range(k)), None, "farm") for k in range(30)]  # a host of short ones
    rows += [(first + 600, prose[30][1] + " farm", None, "farm"), (first + 601, prose[31][1] + " free", None, None)]
    rows += [rows[0], rows[-1], (2**60 + 1, prose[33][1] + " large id", None, "mixed")]
    return [(*r, 0, 5, 1, "clash", [1, 2]) for r in rows]


def kept_by_quality(rows):
    failed, hosts = [], defaultdict(list)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        failed.append(len(words) < 50 or 100 * brute_repeat(words) > 50 * len(words))
        if r[3] is not None:
            hosts[r[3]].append(failed[-1])
    rates = [sum(f) / len(f) for f in hosts.values()]
    m, v = np.mean(rates), np.var(rates)
    s = max(1.0, m * (1 - m) / v - 1) if v > 1e-12 else 1e6
    bad = {h for h, f in hosts.items() if (sum(f) + m * s) / (len(f) + s) > quality.MAX_HOST_RATE}
    return [r for r, f in zip(rows, failed, strict=True) if not f and r[3] not in bad]


def log_probability(word, vocab, logs):
    """Sum over all segmentations of one word, edge by edge."""
    text = SPACE + word
    alpha = [0.0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        terms = [alpha[b] + logs[vocab.ids[text[b:e]]] for b in range(max(0, e - vocab.longest), e) if text[b:e] in vocab.ids]
        if text[e - 1] not in vocab.ids:
            terms.append(alpha[e - 1] + sum(logs[vocab.bytes[b]] for b in text[e - 1].encode()))
        top = max(terms, default=-math.inf)
        alpha[e] = top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top
    return alpha[-1]


def kept_by_language(rows, model):
    languages, prob = model
    vocab = pieces(PIECES)
    with np.errstate(divide="ignore"):
        logs = [np.log(prob[:, k]).tolist() for k in range(len(languages))]
    memo, out = {}, []
    for r in rows:
        found = langid.words(r[1])
        for w in set(found) - memo.keys():
            memo[w] = [log_probability(w, vocab, x) for x in logs]
        total = [sum(memo[w][k] for w in found) for k in range(len(languages))]
        top = max(total)
        if found and 1 / sum(math.exp(max(t - top, -700)) for t in total) >= 0.5:
            out.append(r)
    return out


def test_run_against_brute_force(spark, tmp_path):
    rows = fixture(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    good = kept_by_quality(rows)
    assert 50 < len(good) < len(rows) and not any(r[3] == "farm" for r in good)
    model = langid.train(spark.createDataFrame(good, SCHEMA), PIECES)
    known = kept_by_language(good, model)
    assert len(known) > 50
    texts = {r[0]: r[1] for r in known}
    lines = {r[0]: r for r in known}
    left = {}
    for d, (_, dropped, digest) in brute_lines(texts).items():
        left[d] = (dropped, digest)
    assert any(n for n, _ in left.values())
    deduped = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(known, SCHEMA), "").collect()}
    import hashlib

    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in deduped.items()} == {d: x for d, (_, x) in left.items()}
    keep = {d for d, (_, c) in brute(deduped).items() if c == d}
    assert 0 < len(keep) < len(lines)
    want = [r for r in known if r[0] in keep]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    ids = {d: np.array([*tokenizer.encode(deduped[d], add_special_tokens=False).ids, 2], "<u4") for d in keep}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == keep
    copies = defaultdict(int)
    for r in want:
        copies[r[0]] += 1
    covered, used = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sorted(c) == sorted(list(range(len(ids[d]))) * copies[d]) for d, c in covered.items())
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_every_stage_keeps_columns_and_takes_nulls_everywhere(spark):
    rows = [(None,) * 9, (1, None, None, None, None, None, None, None, None), (None, "a b c d e f g", None, None, None, None, None, None, [None])]
    docs = spark.createDataFrame(rows * 2, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.count() <= 6
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 6

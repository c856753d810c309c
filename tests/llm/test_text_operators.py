"""Small exact cases and brute-force comparisons of the text operators."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from posekit.llm import htmltext, huffman, langid, licenses, linededup, nbest, packing, quality  # noqa: E402
from posekit.llm.common import lower_ascii, words_of  # noqa: E402
from posekit.llm.wordcache import ChunkEncoder, encoder  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, host string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "the quick brown fox jumps over the lazy dog again"  # 49 code points


def docs(spark, texts, lang=None, source="s"):
    """Documents with two extra columns whose names clash with results."""
    rows = [(k, t, lang, source, 0, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words_are_cut_at_six_characters_only():
    text = "a\tb\x0bc\x0cd\re\nf g\x1ch\x85i\xa0j"
    assert [w.decode() for w in words_of(text)] == re.findall(r"[^\x20\x09-\x0D]+", text)
    assert words_of(None) == [] and lower_ascii("ÀBC") == "Àbc"


# Quality rules


def brute_repeat(words):
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    return len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)})


def test_repeat_words_against_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(rng.randint(0, 30))]
        assert quality.repeat_words(words) == brute_repeat(words)


def test_quality_of_odd_documents(spark):
    good = " ".join(f"w{k}" for k in range(60))
    df = docs(spark, [None, "", good, "x " * 200, "a#b\n\nq\nq \n q\nq"])
    got = by_id(quality.judged(quality.metrics(df)))
    assert [got[k]["n_words"] for k in range(5)] == [0, 0, 60, 200, 5]
    assert got[4]["n_symbols"] == 1 and got[4]["n_dup_lines"] == 1
    assert got[3]["n_repeat_words"] == 200 and got[3]["base_failed"] and not got[2]["base_failed"]
    assert quality.judged(quality.metrics(docs(spark, []))).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good if k % 10 == 0 else "bad", None, "farm" if k < 100 else f"h{k % 5}", 0, "", "") for k in range(100)]
    rows += [(100 + k, good, None, f"h{k % 5}", 0, "", "") for k in range(100)] + [(999, good, None, None, 0, "", "")]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)  # one repeated row
    got = quality.judged(quality.metrics(df)).collect()
    assert len(got) == 202 and not any(r["kept"] for r in got if r["host"] == "farm")
    assert all(r["kept"] for r in got if r["host"] != "farm")
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns and kept.count() == 101


# Line dedup


def brute_lines(texts):
    key = lambda x: lower_ascii(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in gone and d != gone[key(x)])]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def dedup_digest(df):
    got = linededup.dedup_lines(df)
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect()}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    pool = [LONG + str(k % 7) for k in range(7)] + ["short", "", "  " + LONG.upper() + "0\t", "é" * 40, "x" * 39]
    texts = {k: "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) for k in range(60)} | {60: None, 61: "", 62: "\n\n"}
    df = docs(spark, list(texts.values()))
    assert dedup_digest(df) == brute_lines(texts)
    assert linededup.dedup_lines(df).columns[: len(df.columns)] == df.columns
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_with_clashing_columns_and_repeated_rows(spark):
    rows = [(k % 6, LONG + "\nown", "keep", 7, 8, [1]) for k in range(12)] + [(None, LONG, "null id", 1, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines string, n_lines long, n_dropped long, _drops array<int>")
    got = linededup.dedup_lines(df).orderBy("doc_id").collect()
    assert linededup.dedup_lines(df).columns == ["doc_id", "text", "lines", "_drops", "n_lines", "n_dropped"]
    assert [(r["doc_id"], r["text"], r["lines"], r["n_lines"], r["n_dropped"]) for r in got[1:]] == [(k // 2, "own" if k < 10 else LONG + "\nown", "keep", 2, int(k < 10)) for k in range(12)]
    assert tuple(got[0]) == (None, LONG, "null id", None, 1, 0)


@pytest.mark.parametrize("line", [" \tÀÉ Hello\x0b", "ǅ Abc", "Ⓐ ABC Ⅷ", "İI", "ΑΣ Q", "plain", "\x0c\r", "\u00a0A\u00a0", "Straße ẞ"])
def test_line_keys_lower_only_ascii(spark, line):
    want = line.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})
    assert spark.createDataFrame([(line,)], "line string").select(linededup.line_key(F.col("line")).alias("k")).first()["k"] == want


def test_runs_are_compacted_and_count_alike(spark):
    keys = linededup.line_keys(docs(spark, [LONG, LONG, LONG + "!", LONG] * 3))
    store = linededup.LineRuns(spark, fanout=2)
    for batch in linededup.batches(keys, least=6):
        store.add(batch)
    assert max(map(len, store.levels)) < 2 and len(store.levels) > 1
    got = {(r["owner"]) for r in store.verdicts(3).collect()}
    assert got == {11, 10}


# Language ID


def test_forward_sums_all_segmentations():
    vocab = langid.pieces(PIECES)
    rng = np.random.default_rng(0)
    prob = rng.dirichlet(np.ones(vocab.size), 2).T

    def brute(w):
        if not w:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(w) + 1):
            if w[:k] in vocab.ids:
                out += prob[vocab.ids[w[:k]]] * brute(w[k:])
            elif k == 1:
                out += np.prod(prob[[vocab.bytes[x] for x in w[:1].encode()]], axis=0) * brute(w[1:])
        return out

    words = ["the", "nation", "été", "日本ωx", "a", "𝔘z"]
    lat = vocab.lattices(["▁" + w for w in words])
    alpha = langid.forward(lat, langid.edge_probabilities(lat, prob))[lat.last]
    assert np.allclose(alpha, [brute("▁" + w) for w in words], rtol=1e-9)
    counts = langid.expected_counts(vocab, words, np.ones(len(words)), prob[:, 0])
    assert counts.min() >= 0 and counts.sum() > len(words)


def test_improbable_words_stay_finite():
    vocab = langid.pieces(PIECES)
    rng = np.random.default_rng(1)
    prob = rng.dirichlet(np.ones(vocab.size), 2).T
    for letter in ("\u3402", "\U0002070e", "\u12ff"):
        assert letter not in vocab.ids and letter.isalpha()
        word = letter * langid.MAX_WORD
        spelled = [vocab.bytes[x] for x in letter.encode()]
        want = np.log(prob[vocab.ids["▁"]]) + langid.MAX_WORD * np.log(prob[spelled]).sum(axis=0)
        assert np.allclose(langid.word_logs(vocab, [word, "the"], prob)[0], want, rtol=1e-12)
        counts = langid.expected_counts(vocab, ["the", word], np.array([1.0, 5.0]), prob[:, 0])
        assert np.isfinite(counts).all() and counts[spelled[0]] >= 5 * langid.MAX_WORD * (1 - 1e-9)
    words = ["the", "nation", "日本ωx", "𝔘z"]
    lat = vocab.lattices(["▁" + w for w in words])
    assert np.allclose(langid.log_forward(lat, langid.edge_logs(lat, prob)), np.log(np.maximum(langid.forward(lat, langid.edge_probabilities(lat, prob)), 1e-300)), rtol=1e-9)
    assert np.allclose(langid.log_expected_counts(vocab, words, np.ones(4), prob[:, 0]), langid.expected_counts(vocab, words, np.ones(4), prob[:, 0]))


def test_language_id_with_an_improbable_word(spark):
    rare = "\u3402" * langid.MAX_WORD
    texts = [("the house and the garden of the nation " * 20, "en"), ("das Haus und der Garten der ganzen Nation " * 20, "de")]
    rows = [(k, texts[k % 2][0] + (rare if k < 8 else ""), texts[k % 2][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, PIECES).collect()}
    assert all(got[k]["lang_pred"] == lang and got[k]["score"] > 0.99 for k, _, lang in rows)
    assert langid.keep_identified(df, langid.train(df, PIECES), PIECES).count() == 40


def test_language_id_held_out_and_odd_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs(spark, [None, "", "123 ###", "the " * 50_000]).select(F.col("doc_id") + 10_000_000, "text", "lang", "source", "n_chars").toDF(*df.columns)
    got = langid.identify(df.union(odd), PIECES).join(df.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    far = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] >= 10_000_000}
    assert [far[10_000_000 + k] for k in range(3)] == [("und", 0.0)] * 3 and far[10_000_003][0] == "en"
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_id_without_labels(spark):
    got = langid.identify(docs(spark, ["some text", None]), PIECES).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert langid.identify(docs(spark, []), PIECES).count() == 0


# HTML

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="ad">Buy this wonderful thing now, it is very cheap and very good for you.</div>
<aside>Other stories that nobody asked for but which are long enough to look like text.</aside>
%s<form><input name=q><button>Go</button></form><section id="comments"><p>First! What a great article this was, thank you so much.</p></section>
<footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<nav><a>x</a></nav>", ""),
        (PAGE % "<article><h1>A &amp;amp; B</h1><p><b>One<br>two  <i>x</i>\n<p>Short.</p></article>", "A &amp; B\n\nOne two x\n\nShort."),
        (PAGE % ("<div class='content'><h1>Title of it</h1><p>" + LONG + ".</p><p>Mid.</p><p>" + LONG + "!</p></div>"), f"Title of it\n\n{LONG}.\n\nMid.\n\n{LONG}!"),
        ("<article><h1>Cut off</h1><p>text goes on", "Cut off\n\ntext goes on"),
        ("<nav><ul><li>never closed<article><p>body</p></article>", "body"),
        ("<article><p>a</p><p>a</p><div class='ads'>no<div>no</div></div><p>b</p></article>", "a\n\na\n\nb"),
    ],
)
def test_main_text(html, want):
    assert htmltext.main_text(html) == want


BODY = "".join(f"<p>Paragraph {k} of the text, which is long enough for a surge.</p>" for k in range(6))
WANT = "\n\n".join(f"Paragraph {k} of the text, which is long enough for a surge." for k in range(6))


@pytest.mark.parametrize(
    "html",
    [
        *[f'<body><div class="{c}"><article>{BODY}</article></div></body>' for c in ("layout has-sidebar", "no-sidebar", "search-page", "page-header-fixed", "sidebar", "widget")],
        *[f'<body><nav>Home</nav><div class="{c}">{BODY}</div><div class="sidebar">A few words about us, in a column at the side.</div></body>' for c in ("search-page", "with-sidebar", "widget")],
        f'<body><article>{BODY}<div class="comments">{"<p>A comment that goes on and on about the article.</p>" * 20}</div></article></body>',
        f'<body><main><div class="widget">{BODY}</div></main></body>',
        f'<body><div class="overlay"><main>{BODY}</main></div></body>',
        f"<body><div>{BODY}</div>" + "<article><a href=x>Teaser</a></article>" * 3 + "</body>",
        f'<body><article>{BODY}</article><section id="comments"><article class="comment"><p>First! What a great article this was.</p></article></section></body>',
        f'<body><article>{BODY}</article><div class="sidebar-left"><article><p>A teaser of another article on this site.</p></article></div></body>',
    ],
)
def test_wrappers_and_teasers(html):
    assert htmltext.main_text(html) == WANT


PARAGRAPHS = [f"Paragraph {k} of the text, which is long enough for a surge." for k in range(3)]
SHORT_BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
THREAD = "".join(f'<div class="item"><p>Comment {k}: I agree with nothing of what was said above, and will say so at length.</p></div>' for k in range(12))
ADVERT = "Buy this wonderful thing now, it is very cheap and very good for you."
CONSENT = "We use cookies and other things to make this site better for everyone."


@pytest.mark.parametrize("thread", ['section id="comments"', 'ol class="comment-list"', 'div id="disqus_thread"', 'div class="replies"', 'div class="comments-area"', 'div id="respond"', 'div class="sidebar"', 'div class="cookie-notice"'])
@pytest.mark.parametrize("text", ["<article>%s</article>", "<div class=post>%s</div>", "<main><div class=widget>%s</div></main>", "<div class=widget><h1>Paragraph</h1>%s</div>", "<article>%s"])
def test_threads_longer_than_the_text_go(thread, text):
    got = htmltext.main_text(f"<body>{text % SHORT_BODY}<{thread}>{THREAD}</{thread.split()[0]}></body>")
    assert got.removeprefix("Paragraph\n\n") == "\n\n".join(PARAGRAPHS)


@pytest.mark.parametrize(
    "html, want",
    [
        (f'<body><div class="cc-window">{CONSENT}</div><article>{SHORT_BODY}</article><div>{ADVERT}</div></body>', PARAGRAPHS),
        (f"<body><div>{CONSENT}</div><div id=x>{SHORT_BODY}</div><div>{ADVERT}</div></body>", PARAGRAPHS),
        (f"<body><div><div>{CONSENT}</div><div><section>{SHORT_BODY}</section><section>{SHORT_BODY}</section></div></div></body>", PARAGRAPHS * 2),
        (f"<body><div class=overlay><div class=modal>{SHORT_BODY}</div></div><div class=ad>{ADVERT * 20}</div></body>", PARAGRAPHS),
        (f"<body>{SHORT_BODY}</body>", PARAGRAPHS),
        ("<body><p>Only one short line.</p></body>", ["Only one short line."]),
        ("<article>Hi</article>", ["Hi"]),
        (f"<article><p>Read on.</p></article><div>{SHORT_BODY}</div>", PARAGRAPHS),
    ],
)
def test_notices_adverts_and_pages_without_article(html, want):
    assert htmltext.main_text(html) == "\n\n".join(want)


def test_pages_against_their_trees():
    """Random well-formed trees: what stands in the article and under no dropped element, block by block."""
    rng = random.Random(9)
    drops = ["nav", "aside", "form", "footer", 'div class="ads"', 'div class="social-share"', 'ul id="related-posts"', 'section id="comments"']

    def tree(depth, inside, want):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind, words = rng.random(), " ".join(rng.choice(["one", "zwei", "été", "&amp;", "x<b>y</b>"]) for _ in range(rng.randint(8, 14)))
            if kind < 0.5 or not depth:
                out.append(f"<p>{words}</p>")
                if inside:
                    want.append(words.replace("<b>", "").replace("</b>", "").replace("&amp;", "&"))
            elif kind < 0.75:
                out.append(f"<div>{tree(depth - 1, inside, want)}</div>")
            else:
                tag = rng.choice(drops)
                out.append(f"<{tag}>{tree(depth - 1, False, want)}</{tag.split()[0]}>")
        return "".join(out)

    for _ in range(300):
        want = []
        before, article, after = tree(2, False, []), tree(3, True, want), tree(2, False, [])
        if sum(map(len, want)) >= 200:
            assert htmltext.main_text(f"<body>{before}<article>{article}</article>{after}</body>") == "\n\n".join(want)


def test_no_pages(spark):
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extract_keeps_every_page(spark):
    df = spark.createDataFrame([(1, "u", None, "z"), (2, None, "<article>é&eacute;</article>", "z"), (2, None, "<article>é&eacute;</article>", "z")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()) == [(1, "", 0), (2, "éé", 2), (2, "éé", 2)]


# Licences


def test_licences(spark):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    texts = ["prose\nReleased under the MIT license", "Copyright (c) 2020 Me\n\n" + next(t for n, t in licenses.KNOWN if n == "ISC").upper().replace("-", " "), None, "...", mit.replace("License", "Licence"), "a licence licence"]
    got = by_id(licenses.scan(docs(spark, texts)))
    assert [got[k]["whole_licence"] for k in range(6)] == [None, "ISC", None, None, "MIT", None]
    assert got[0]["line_licences"] == "MIT" and got[4]["n_licence_lines"] == 1 and got[2]["digest"] is None
    extra = spark.createDataFrame([("own", "Prose!")], "licence string, text string")
    assert by_id(licenses.scan(docs(spark, texts), extra))[0]["line_licences"] == "own"
    assert licenses.scan(docs(spark, [])).count() == 0


def test_licences_of_repeated_rows_and_null_ids(spark):
    notice = "prose\nReleased under the MIT License.\nReleased under the MIT License.\nLicensed under CC BY 4.0."
    rows = [(7, notice), (7, notice), (None, notice), (7, "prose"), (8, None), (9, "")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, hits string, salt int")
    got = sorted(((r["doc_id"] or -1, r["line_licences"], r["n_licence_lines"]) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(-1, "CC-BY-4.0,MIT", 3), (7, "CC-BY-4.0,MIT", 3), (7, "CC-BY-4.0,MIT", 3), (7, "", 0), (8, "", 0), (9, "", 0)], key=str)
    own = spark.createDataFrame([("Mine", "do as you like")], "licence string, text string")
    assert [r["n_licence_lines"] for r in licenses.scan(df.where("doc_id = 7").limit(1), own).collect()] == [0]


def test_every_built_in_text_passes_the_word_test(spark):
    """could_match keeps each line of a text of one line; longer texts are matched whole."""
    short = [(t,) for _, t in licenses.built_in() if "\n" not in t.strip()]
    assert short and spark.createDataFrame(short, "t string").where(~licenses.could_match(F.col("t"))).count() == 0


def test_full_licences_however_wrapped(spark):
    import textwrap

    known = {n: t for n, t in licenses.KNOWN}
    wrap = lambda t, w: "\n\n".join(textwrap.fill(p, w) for p in t.split("\n\n"))
    # The usual wrapping of ISC, where a line starts "copyright notice and this permission notice".
    isc = known["ISC"].replace("provided that the above copyright", "provided that the above\ncopyright")
    assert "\ncopyright notice and this permission" in isc
    bsd = [t for n, t in licenses.built_in() if n == "BSD-3-Clause" and t.startswith("Redistribution")][0]
    two = [t for n, t in licenses.built_in() if n == "BSD-2-Clause" and t.startswith("Redistribution")][0]
    full = {p.stem: p.read_text() for p in (licenses.Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    texts = [("MIT", f"{title}Copyright (c) 2021 A. Person\n\n" + wrap(known["MIT"], w)) for title in ("", "MIT License\n\n", "The MIT License (MIT)\n\n") for w in range(60, 82, 3)]
    texts += [("ISC", "ISC License\n\nCopyright 2020 Some Body\n\n" + isc), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2019, X\nAll rights reserved.\n\n" + wrap(bsd, 72)), ("BSD-2-Clause", "Copyright X Y\n" + two)]
    texts += list(full.items()) + [(k, textwrap.indent(t, " * ")) for k, t in full.items()]
    texts += [("Apache-2.0", full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2024 Me")), (None, "MIT License\n"), (None, "prose")]
    got = by_id(licenses.scan(docs(spark, [t for _, t in texts])))
    assert [got[k]["whole_licence"] for k in range(len(texts))] == [n for n, _ in texts]
    notices = ["This project is licensed under the BSD 3-Clause License.", "Licensed under CC BY-SA 3.0", "Released under the GNU General Public License, version 2", "Distributed under the GNU Lesser General Public License v2.1", "Released under MPL 2.0."]
    got = by_id(licenses.scan(docs(spark, [f"prose\n{x}\nmore" for x in notices])))
    assert [got[k]["line_licences"] for k in range(5)] == ["BSD-3-Clause", "CC-BY-SA-3.0", "GPL-2.0", "LGPL-2.1", "MPL-2.0"]


# Token ids


def odd_texts():
    rng = random.Random(2)
    parts = ["a", "the,", "don't", "x's", "é", "ß", "́", "İ,", "Σ", "12", "...", "###", "\n", "\n\n", "  ", " ", "\t", "\xa0", "\x1c", "<|endoftext|>", "日本", "🙂", "\0", "\x01", "_"]
    return [None, "", " ", "\n"] + ["".join(rng.choice(parts) + rng.choice([" ", "", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(800)]


@pytest.mark.parametrize("path, drops", [(BYTES, False), (WORDS, True)])
def test_chunked_ids_equal_the_tokenizer(path, drops):
    enc = ChunkEncoder(path, drops)
    texts = odd_texts()
    for part in (texts, texts[::-1]):
        flat, n = enc.ids(part)
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids if t else [] for t in part]
        assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("path, drops", [(BYTES, False), (WORDS, True)])
def test_ids_equal_a_fresh_tokenizer(path, drops):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = odd_texts() + ["hello <|endoftext|> world", "a<|endoftext|>, b\n<|startoftext|>", "<|EndOfText|>", "<|endoftext|>", "<|endoftext|><|endoftext|> x|", "hello world."]
    enc = ChunkEncoder(path, drops)
    for part in (texts, texts[::-1]):
        flat, n = enc.ids(part)
        want = [plain.encode(t, add_special_tokens=False).ids if t else [] for t in part]
        assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_token_files_hold_the_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES)
    texts = ["hello <|endoftext|> world", "more text"]
    got = by_id(huffman.roundtrip(docs(spark, texts), BYTES, 0))
    for k, t in enumerate(texts):
        ids = plain.encode(t, add_special_tokens=False).ids + [0]
        assert (got[k]["n_tokens"], got[k]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_code_lengths():
    rng = np.random.default_rng(0)
    counts = np.zeros(3000, int)
    counts[:2500] = (rng.pareto(1.0, 2500) * 5 + 1).astype(int)
    for bits in (12, 16):
        n = huffman.code_lengths(counts, bits)
        assert n.max() <= bits and math.isclose(sum(2.0 ** -int(x) for x in n if x), 1.0)
    assert huffman.code_lengths(np.array([0, 3]), 4).tolist() == [0, 1] and not huffman.code_lengths(np.zeros(4, int)).any()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(0.7, n) * 3).astype(int) % 5000
    lengths = huffman.code_lengths(np.bincount(np.append(ids, range(5000)), minlength=5000))
    bits, offsets = huffman.pack_bits(ids, huffman.canonical(lengths), lengths)
    assert (huffman.unpack_bits(bits, offsets, n, huffman.decode_table(lengths)) == ids).all()


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 50)
    texts = odd_texts()[:60]
    df = docs(spark, texts).repartition(5)
    tok = encoder(BYTES, False).tokenizer
    want, start = {}, 0
    for k, t in enumerate(texts):
        ids = (tok.encode(t, add_special_tokens=False).ids if t else []) + [0]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in huffman.roundtrip(df, BYTES, 0).collect()}
    assert got == want
    assert huffman.roundtrip(docs(spark, []), BYTES, 0).count() == 0


# Packing


def check_pieces(rows, capacity=4096):
    seqs, docs_ = {}, {}
    for d, start, n, s, offset in rows:
        seqs.setdefault(s, []).append((offset, n))
        docs_.setdefault(d, []).append((start, n))
    for parts in [*seqs.values(), *docs_.values()]:
        at = 0
        for x, n in sorted(parts):
            assert x == at and n > 0
            at += n
    used = [sum(n for _, n in p) for p in seqs.values()]
    assert all(u == capacity or u < capacity and u & (u - 1) == 0 for u in used)
    return {d: sum(n for _, n in p) for d, p in docs_.items()}


def test_assignment():
    rng = np.random.default_rng(0)
    for _ in range(100):
        lengths = rng.integers(1, 9000, rng.integers(1, 60))
        assert check_pieces(packing.assign(lengths)) == dict(enumerate(lengths.tolist()))
    assert packing.capacities(4096 * 2 + 5).tolist() == [4096, 4096, 4, 1]


def test_packing_of_odd_documents(spark):
    df = docs(spark, [None, "", "a b c", "word " * 9000, "a b c"]).union(docs(spark, ["again"]))
    rows = packing.pack(df.where("doc_id > 0 OR text IS NOT NULL").coalesce(1), WORDS, 2).collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert tokens[1] == 1 and tokens[3] == 9001 and tokens[2] == 4
    assert check_pieces([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in rows]) == tokens
    assert packing.pack(docs(spark, []), WORDS, 2).count() == 0
    assert packing.pack(docs(spark, [None]), WORDS, 2).first()["length"] == 1


# N-best


def test_n_best_against_all_paths():
    seg = nbest.Segmenter(PIECES, 4)
    rng = random.Random(0)

    def every(text):
        edges = nbest.edge_lists(seg.vocab, ["▁" + text.replace(" ", "▁")])[0]
        memo = [[(0.0, ())]]
        for here in edges[1:]:
            memo.append([(s0 + s, p + ids) for a, s, ids in here for s0, p in memo[a]])
        return sorted(memo[-1], key=lambda x: -x[0])

    for _ in range(150):
        text = "".join(rng.choice("aehtno  s,é日🙂\n") for _ in range(rng.randint(1, 9)))
        want, got = every(text), seg.n_best(text)
        assert np.allclose([s for s, _ in got], [s for s, _ in want[:4]])
        assert len({tuple(i) for _, i in got}) == len(got) and all(seg.decode(i) == text for _, i in got)
        assert {tuple(i) for _, i in got} <= {p for _, p in want}


def test_token_files_of_repeated_rows_and_null_ids(spark):
    df = docs(spark, ["same text", "same text", None]).select("doc_id", "text")
    rows = df.union(df.where("doc_id = 0")).union(df.where("doc_id = 1").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text"))
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in huffman.roundtrip(rows, BYTES, 0).collect()))
    assert len(got) == 5 and len({r[2:] for r in got if r[0] != 2}) == 1
    starts = sorted((r[1], r[2]) for r in got)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:k]) for k in range(5)]  # every id lies in exactly one row
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] in ([-1, 0, 0, 1, 2], [0, 0, 1, 2, -1])


def test_n_best_of_odd_documents(spark):
    got = by_id(nbest.digest(docs(spark, [None, "", "  two  blanks ", "x" * 5000, "a▁b"]), PIECES))
    assert got[0]["n_pieces"] == got[1]["n_pieces"] == 0 and all(r["decodes"] for r in got.values())
    full = by_id(nbest.segment(docs(spark, ["hello world", None]), PIECES))
    assert len(full[0]["segmentations"]) == 3 and len(full[1]["segmentations"]) == 1
    assert nbest.digest(docs(spark, []), PIECES).count() == 0


# Line blocks against their definition


def brute_main_lines(found):
    """Window by window, without running state."""
    marks = {a for _, _, a in found if a}
    own, every = sum(n for _, n, a in found if a), sum(n for _, n, _ in found)
    marked = bool(marks) and (2 * own >= every or own >= 120 and (len(marks) == 1 or -1 in marks))
    weight = [(n + htmltext.BONUS if a else 0) if marked else n for _, n, a in found]
    total = lambda k: sum(w for j, w in enumerate(weight) if k <= j < k + htmltext.WINDOW)
    surges = [k for k in range(len(found)) if total(k) >= htmltext.THRESHOLD]
    kept = set()
    for k in surges:
        if any(j < k and all(total(i) for i in range(j, k)) for j in surges):
            continue  # inside the text that an earlier surge began
        dive = next((i for i in range(k, len(found)) if not total(i)), len(found))
        full = [j for j in range(k, dive) if weight[j] and any(total(i) >= htmltext.THRESHOLD for i in (j - htmltext.WINDOW + 1,))]
        full += [j for j in range(k, dive) if weight[j] and j < htmltext.WINDOW - 1 and sum(weight[: j + 1]) >= htmltext.THRESHOLD]
        first = min(j for j in range(k, dive) if weight[j])
        kept |= {j for j in range(first, max(full) + 1) if found[j][2] or not marked}
    few = {j for j, w in enumerate(weight) if w}
    if not surges and (marked or len(few) <= htmltext.WINDOW):
        kept = few
    return [found[j][0] for j in sorted(kept)]


def test_line_blocks_against_brute_force():
    rng = random.Random(6)
    for _ in range(3000):
        marks = rng.choice([[0], [0, 1], [0, 0, -1], [0, 1, 2, 3]])
        found = [(f"l{k}", rng.choice([0, 0, 0, 3, 12, 20, 45, 200]), rng.choice(marks)) for k in range(rng.randint(0, 18))]
        assert htmltext.main_lines(found) == brute_main_lines(found)


@pytest.mark.parametrize("html", ["<header>x" * 20_000, "<![CDATA[" * 40_000, "<script>x" * 20_000, "<nav>" * 40_000, "<div class=menu>" * 20_000 + "t", "<!" * 50_000, "<p>" * 50_000])
def test_hostile_pages_take_linear_time(html):
    import time

    start = time.process_time()
    htmltext.main_text(html)
    assert time.process_time() - start < 5

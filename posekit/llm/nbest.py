"""N-best segmentation over a fixed piece vocabulary, encoding and decoding.

A text (blanks as space marks, one put in front) is a lattice of pieces. The
forward Viterbi pass gives the best score of every prefix; those scores are
exact heuristics for an A-star search that runs backward from the end, so
hypotheses come off the queue best first and the first N complete ones are the
N best.

No piece crosses a word boundary, so a text's lattice is a chain of word
lattices. A word whose second-best path loses more than that of N-1 other words
takes its best path in all N best (each of the others alone gives a better
text); its lattice is replaced by that one path, with the score it has. Only
the N-1 words of smallest loss keep theirs, so the search over a text is short
however long the text is, and exact.

Scores are the model's piece scores; a character without a piece is spelled in
byte pieces, at UNKNOWN a character. Ties: more preferred is the path whose
last piece starts later, from the end backward (longer first by edge order).

Defined cases: null and empty texts have one segmentation, the empty one; texts
with fewer than N segmentations return all; repeated rows each get rows; extra
columns are ignored; very long texts are processed whole; words of any length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from posekit.llm.common import hold, slices, small_batches
from posekit.llm.pieces import SPACE, Lattices, Pieces, pieces

N_BEST = 3
#: Score of a character spelled in bytes: below every piece of the model.
UNKNOWN = -100_000.0
MAX_KEPT = 900_000
SCHEMA = "n_segmentations int, n_pieces long, score double, score_gap double, ids_crc32 long, decodes boolean"


Edges = list[list[tuple[int, float, tuple[int, ...]]]]


def edge_lists(vocab: Pieces, words: list[str]) -> list[Edges]:
    """Per word, by end position: (start, score, ids) of the pieces that end there."""
    lat = vocab.lattices(words)
    out: list[Edges] = [[[] for _ in range(len(w) + 1)] for w in words]
    first = lat.first[lat.word]
    for k, (w, a, b, i, s) in enumerate(zip(lat.word.tolist(), (lat.start - first).tolist(), (lat.end - first).tolist(), lat.ids.tolist(), edge_scores(lat).tolist(), strict=True)):
        out[w][b].append((a, s, tuple(lat.spelling.get(k, (i,)))))
    return out


def edge_scores(lat: Lattices) -> np.ndarray:
    s = lat.vocab.points[lat.ids]
    s[lat.spelled] = UNKNOWN
    return s


def best_paths(lat: Lattices) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: best score and loss of its second-best path; the edges of all best paths, by word, in order.

    The second-best path uses an edge off the best one, and the best path
    through an edge is the best before it, the edge, and the best after it.
    """
    s, nodes = edge_scores(lat), int(lat.size.sum()) + len(lat.words)
    best, after, back = np.full(nodes, -np.inf), np.full(nodes, -np.inf), np.zeros(nodes, np.int64)
    best[lat.first] = after[lat.last] = 0.0
    for span in lat.steps():
        end, value = lat.end[span], best[lat.start[span]] + s[span]
        group = np.flatnonzero(np.diff(end, prepend=-1))
        top = np.maximum.reduceat(value, group)
        best[end[group]] = top
        is_top = value == np.repeat(top, np.diff(group, append=len(value)))
        edge = np.where(is_top, np.arange(span.start, span.stop), len(s))
        back[end[group]] = np.minimum.reduceat(edge, group)
    for span in lat.steps(backward=True):
        np.maximum.at(after, lat.start[span], s[span] + after[lat.end[span]])
    used, at = [], lat.last
    at = at[at > lat.first]
    begin = np.zeros(nodes, bool)
    begin[lat.first] = True
    while len(at):
        used.append(back[at])
        at = lat.start[used[-1]]
        at = at[~begin[at]]
    on = np.concatenate(used) if used else np.zeros(0, np.int64)
    second = np.full(len(lat.words), -np.inf)
    through = best[lat.start] + s + after[lat.end]
    through[on] = -np.inf
    np.maximum.at(second, lat.word, through)
    on = on[np.lexsort((lat.start[on], lat.word[on]))]
    return best[lat.last], best[lat.last] - second, on


def forward_best(edges: Edges) -> list[float]:
    """Viterbi: the best score of each prefix."""
    best = [0.0] + [-np.inf] * (len(edges) - 1)
    for t in range(1, len(edges)):
        for a, s, _ in edges[t]:
            if best[a] + s > best[t]:
                best[t] = best[a] + s
    return best


def a_star(edges: Edges, n: int) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
    """The n best paths as (start, ids) steps, best first, searching backward with the forward scores as heuristic."""
    best = forward_best(edges)
    queue: list = [(-best[-1], 0, len(edges) - 1, 0.0, None)]
    out: list = []
    made = 0
    while queue and len(out) < n:
        _, _, at, behind, path = heapq.heappop(queue)
        if not at:
            steps = []
            while path:
                steps.append(path[0])
                path = path[1]
            out.append((behind, steps))
            continue
        for a, s, ids in edges[at]:
            if best[a] > -np.inf:
                made += 1
                heapq.heappush(queue, (-(best[a] + s + behind), made, a, behind + s, ((a, ids), path)))
    return out


class Segmenter:
    """N-best segmentations of whole texts; a word's best path and loss are found once and kept."""

    def __init__(self, path: str, n: int = N_BEST):
        self.vocab, self.n = pieces(path), n
        v = self.vocab
        self.raw = [bytes([int(t[1:-1], 16)]) if b else t.encode("utf-8", "surrogatepass") for t, b in zip(v.texts, v.is_byte, strict=True)]
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.score, self.loss = np.zeros(1 << 12), np.zeros(1 << 12)
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    def _learn(self, words: list[str]) -> None:
        n, k = len(self.index), len(words)
        while n + k > len(self.first):
            self.score, self.loss, self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.score, self.loss, self.first, self.size))
        words.sort(key=len)
        for a in range(0, k, 8000):
            some = words[a : a + 8000]
            lat = self.vocab.lattices([SPACE + w for w in some])
            self.score[n + a : n + a + len(some)], self.loss[n + a : n + a + len(some)], on = best_paths(lat)
            width = np.ones(len(on), np.int64)
            flat = lat.ids[on]
            if (flat < 0).any():
                width[flat < 0] = [len(lat.spelling[e]) for e in on[flat < 0].tolist()]
                flat = np.array([i for e, x in zip(on.tolist(), flat.tolist(), strict=True) for i in ([x] if x >= 0 else lat.spelling[e])])
            size = np.bincount(lat.word[on], width, minlength=len(some)).astype(np.int64)
            self.size[n + a : n + a + len(some)] = size
            self.first[n + a : n + a + len(some)] = self.used + np.cumsum(size) - size
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        self.index.update(zip(words, range(n, n + k), strict=True))

    def texts(self, texts: list[str | None]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """Per text: (score, ids), best first."""
        per = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        new = set().union(*per).difference(self.index)
        if len(self.index) + len(new) > MAX_KEPT:
            self._empty()
            new = set().union(*per)
        self._learn(list(new))
        codes = [np.fromiter(map(self.index.__getitem__, w), np.int64, len(w)) for w in per]
        spare = [self._open(c) for c in codes]
        names = sorted({SPACE + per[k][o] for k, x in enumerate(spare) for o in x})
        edges = dict(zip(names, edge_lists(self.vocab, names), strict=True))
        for words, code, x in zip(per, codes, spare, strict=True):
            yield self._n_best(code, x, [edges[SPACE + words[o]] for o in x]) if words else [(0.0, np.zeros(0, np.int32))]

    def n_best(self, text: str | None) -> list[tuple[float, np.ndarray]]:
        return next(iter(self.texts([text])))

    def _open(self, code: np.ndarray) -> np.ndarray:
        """Places of the N-1 words of smallest loss, the first ones on ties."""
        k = min(self.n - 1, len(code))
        if not k:
            return np.zeros(0, np.int64)
        loss = self.loss[code]
        least = np.partition(loss, k - 1)[k - 1]
        below = np.flatnonzero(loss < least)
        spare = np.sort(np.concatenate([below, np.flatnonzero(loss == least)[: k - len(below)]]))
        return spare[np.isfinite(loss[spare])]

    def _n_best(self, code: np.ndarray, spare: np.ndarray, lattices: list[Edges]) -> list[tuple[float, np.ndarray]]:
        size = self.size[code]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.first[code] - (ends - size), size)]
        total = float(self.score[code].sum())
        if not len(spare):
            return [(total, ids)]
        # The chain of open words, each its own lattice; all else is one fixed path with the rest of the score.
        chain: Edges = [[]]
        bounds = [0]
        for lattice in lattices:
            base = len(chain) - 1
            chain += [[(a + base, s, i) for a, s, i in here] for here in lattice[1:]]
            bounds.append(len(chain) - 1)
        fixed = total - float(self.score[code[spare]].sum())
        out = []
        for score, steps in a_star(chain, self.n):
            parts, at = [], 0
            for w, o in enumerate(spare.tolist()):
                own = [i for a, step in steps if bounds[w] <= a < bounds[w + 1] for i in step]
                parts += [ids[at : ends[o] - size[o]], np.array(own, np.int32)]
                at = ends[o]
            out.append((fixed + score, np.concatenate([*parts, ids[at:]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation: pieces joined, bytes put together, space marks to blanks, the first one dropped."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass").replace(SPACE, " ")[1:]


_SEGMENTERS: dict[tuple[str, int], Segmenter] = {}


def segmenter(path: str, n: int) -> Segmenter:
    """The segmenter of this worker."""
    hold("segmenter", _SEGMENTERS.clear)
    if (path, n) not in _SEGMENTERS:
        _SEGMENTERS[path, n] = Segmenter(path, n)
    return _SEGMENTERS[path, n]


def segment(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """Per document: doc_id, segmentations (array of score, ids), best first."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = segmenter(path, n)
        for pdf in slices(batches, "text", 500_000):
            got = [[{"score": s, "ids": ids} for s, ids in x] for x in seg.texts(pdf["text"].tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "segmentations": got})

    return rows.mapInPandas(run, f"doc_id {kind}, segmentations array<struct<score: double, ids: array<int>>>")


def digest(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """Per document, figures of its n best: count, pieces and score of the best, loss of the last, crc32 of all ids, and whether all decode to the text."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = segmenter(path, n)
        for pdf in slices(batches, "text"):
            out = []
            for d, t, got in zip(pdf["doc_id"], pdf["text"], seg.texts(pdf["text"].tolist()), strict=True):
                crc = 0
                for _, ids in got:
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                want = (t or "").replace(SPACE, " ")
                out.append((d, len(got), len(got[0][1]), got[0][0], got[0][0] - got[-1][0], crc, all(seg.decode(ids) == want for _, ids in got)))
            yield pd.DataFrame(out, columns=["doc_id", *[c.split()[0] for c in SCHEMA.split(", ")]])

    return rows.mapInPandas(run, f"doc_id {kind}, {SCHEMA}")

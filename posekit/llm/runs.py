"""Runs of repeated words (maximal periodic stretches), from maximal pairs with bounded distance.

A maximal pair (i, j) of length l at distance p = j - i >= 1 (same l words from
i and from j, other words before and after) with p <= l is exactly a stretch of
l + p words with period p that cannot be extended: nothing is extended here.
Stretches of the same place keep their smallest period (the others are its
multiples), which makes them the runs.

Every document is searched on its own, in whole; nothing is shuffled. In a task:

1. Words become 64-bit hashes. As l >= p and l + p >= 12, both ends of a pair
   begin with the same six words. Places are grouped by them; a group in which
   all places follow the same word has no pair that is maximal to the left.
2. Texts with groups left get suffix ranks by prefix doubling (only groups that
   are not resolved yet are sorted again); the ranks of all levels give the
   longest common prefix of neighbours.
3. Each group is a subtree of the LCP-interval tree and is walked bottom up. An
   interval holds its places in order, as blocks of one left word. The smaller
   child looks up each of its places in the larger: places at most l away, and
   over blocks of its own left word it leaps to the next one. The work is
   n log^2 n plus the pairs found, also for a text of one word repeated.

Defined cases: null or empty text, or one without words, has no run and the
digests of the empty string; a null doc_id is never made periodic by
`with_tails`; repeated rows each get a row; an empty table gives no rows; extra
columns are ignored. Ties of length go to the smallest start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posekit.llm.common import arrow_slices, hold, small_batches, word_table

MIN_WORDS = 12
#: The two places of a pair share so many words at least, as l >= p and l + p >= MIN_WORDS.
SEED = MIN_WORDS // 2
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_M = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """Places of an LCP interval in rising order; heads are those that follow another word than the place before them in the list."""

    __slots__ = ("at", "heads")

    def __init__(self, at: list[int], left: dict[int, int]):
        self.at = at
        self.heads = [y for k, y in enumerate(at) if not k or left[y] != left[at[k - 1]]]

    def near(self, x: int, reach: int, left: dict[int, int]) -> Iterator[int]:
        """Places at most reach away from x that follow another word than x does."""
        at, mine = self.at, left[x]
        k = bisect_left(at, x - reach)
        while k < len(at) and at[k] <= x + reach:
            if left[at[k]] != mine:
                yield at[k]
                k += 1
                continue
            b = bisect_right(self.heads, at[k])
            if b == len(self.heads):
                return
            k = bisect_left(at, self.heads[b], k)

    def take(self, other: Places, left: dict[int, int]) -> None:
        if 8 * len(other.at) > len(self.at):
            self.__init__(sorted(self.at + other.at), left)
            return
        for x in other.at:
            k = bisect_left(self.at, x)
            self.at.insert(k, x)
            if not k or left[self.at[k - 1]] != left[x]:
                insort(self.heads, x)
            if k + 1 < len(self.at):
                y = self.at[k + 1]
                b = bisect_left(self.heads, y)
                known = b < len(self.heads) and self.heads[b] == y
                if known and left[y] == left[x]:
                    del self.heads[b]
                elif not known and left[y] != left[x]:
                    self.heads.insert(b, y)


def maximal_pairs(order: list[int], lcp: list[int], left: dict[int, int]) -> list[tuple[int, int, int]]:
    """(i, j, l) with i < j, j - i <= l: places that share exactly l words and follow different ones.

    order: places in suffix order; lcp[k]: words that order[k - 1] and order[k] share.
    """
    found: list[tuple[int, int, int]] = []

    def joined(a: Places, b: Places, common: int) -> Places:
        if len(a.at) < len(b.at):
            a, b = b, a
        for x in b.at:
            found.extend((min(x, y), max(x, y), common) for y in a.near(x, common, left))
        a.take(b, left)
        return a

    open_: list[tuple[int, Places]] = []
    done = Places([order[0]], left)
    for k in range(1, len(order) + 1):
        common = lcp[k] if k < len(order) else -1
        while open_ and open_[-1][0] >= common:
            depth, held = open_.pop()
            done = joined(held, done, depth)
            if depth == common:
                break
        open_.append((common, done))
        if k < len(order):
            done = Places([order[k]], left)
    return found


def seeds(word: np.ndarray, doc: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that begin with the same SEED words as another of their text, by groups that follow two words at least; and the group of each."""
    m = len(word) - SEED + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = doc[:m].astype(np.uint64) + np.uint64(1)
    for k in range(SEED):
        key = key * _M + word[k : m + k]
    at = np.flatnonzero(doc[:m] == doc[SEED - 1 :])
    at = at[np.argsort(key[at], kind="stable")]
    new = np.append(True, key[at][1:] != key[at][:-1])[: len(at)]
    group = np.cumsum(new) - 1
    other = np.bincount(group[1:], (~new[1:]) & (left[at][1:] != left[at][:-1]), int(group[-1]) + 1) > 0 if len(at) else np.zeros(0, bool)
    return at[other[group]], group[other[group]]


def suffix_levels(word: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Rank arrays: in levels[k] places have equal ranks if they share 2^k words within their text; in the last all differ. end: where the text of each place ends."""
    n = len(word)
    order = np.argsort(word, kind="stable")
    first = np.append(True, word[order][1:] != word[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, width = [rank], 1
    while True:
        shared = np.bincount(rank, minlength=n)[rank] > 1
        active = np.flatnonzero(shared)
        if not len(active):
            return levels
        nxt = active + width
        second = np.where(nxt < end[active], rank[np.minimum(nxt, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        old = rank[active]
        begins = np.append(True, old[1:] != old[:-1])
        fresh = begins | np.append(True, second[1:] != second[:-1])
        k = np.arange(len(active))
        base = np.maximum.accumulate(np.where(begins, k, 0))
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(fresh, k, 0)) - base
        levels.append(rank)
        width *= 2


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the places a and b share."""
    n = len(levels[0])
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]) & (x != y)
        out += same << k
    return out


def pairs_of(word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, l of all maximal pairs with j - i <= l and l + j - i >= MIN_WORDS, within texts that lie between bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = np.append(np.uint64(0), word[:-1])[: len(word)]
    left[bounds[:-1][np.diff(bounds) > 0]] = 0  # nothing before the first word
    at, group = seeds(word, doc, left)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    # Only the texts with groups are ranked, side by side.
    some = np.zeros(len(bounds) - 1, bool)
    some[doc[at]] = True
    kept = np.flatnonzero(some[doc])
    sizes = np.diff(bounds)[some]
    end = np.repeat(np.cumsum(sizes), sizes)
    levels = suffix_levels(word[kept] * _M ^ (doc[kept].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), end)
    local = np.searchsorted(kept, at)
    by = np.lexsort((levels[-1][local], group))
    at, local, group = at[by], local[by], group[by]
    lcp = np.append(0, common_prefix(levels, local[:-1], local[1:]))
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    lcp[begins] = 0
    # A group can hold a pair only if its nearest places are no further apart than its longest prefix.
    place = np.sort(at + group * np.int64(1 << 40)) - np.sort(group) * np.int64(1 << 40)
    gap = np.append(np.int64(1 << 40), np.diff(place))
    gap[begins] = 1 << 40
    can = np.minimum.reduceat(gap, begins) <= np.maximum.reduceat(lcp, begins)
    size = np.diff(np.append(begins, len(at)))
    two = begins[can & (size == 2)]
    i, j, common = np.minimum(at[two], at[two + 1]), np.maximum(at[two], at[two + 1]), lcp[two + 1]
    good = (left[i] != left[j]) & (j - i <= common)
    i, j, common = i[good], j[good], common[good]
    more: list[tuple[int, int, int]] = []
    for b, n in zip(begins[can & (size > 2)].tolist(), size[can & (size > 2)].tolist(), strict=True):
        order = at[b : b + n]
        more += maximal_pairs(order.tolist(), lcp[b : b + n].tolist(), dict(zip(order.tolist(), left[order].tolist(), strict=True)))
    if more:
        x = np.array(more, np.int64)
        i, j, common = np.append(i, x[:, 0]), np.append(j, x[:, 1]), np.append(common, x[:, 2])
    long_enough = common + j - i >= MIN_WORDS
    return i[long_enough], j[long_enough], common[long_enough]


def runs_of(word: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Text number -> its runs (start, length, period) by start, then period."""
    i, j, common = pairs_of(word, bounds)
    best: dict[tuple[int, int], int] = {}
    for a, p, n in zip(i.tolist(), (j - i).tolist(), common.tolist(), strict=True):
        best[a, p + n] = min(p, best.get((a, p + n), p))
    out: dict[int, list[tuple[int, int, int]]] = {}
    docs = np.searchsorted(bounds, [a for a, _ in best], side="right") - 1
    for ((a, n), p), d in zip(best.items(), docs.tolist(), strict=True):
        out.setdefault(d, []).append((a - int(bounds[d]), n, p))
    return {d: sorted(r, key=lambda x: (x[0], x[2])) for d, r in out.items()}


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: of each run its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def no_tails(doc_id: int | None, n: int) -> tuple[int, int] | None:
    return None


def with_tails(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): words from a on are to repeat the p words there. Drawn from crc32 of the id, for one document in ten."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def detect(docs: DataFrame, tail: Callable[[int | None, int], tuple[int, int] | None] = no_tails) -> DataFrame:
    """Runs of every document: their number, the longest, and digests of all runs and of the text without repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("runs")
        for batch in arrow_slices(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            data = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            word, bounds = word_table(data)
            source = np.arange(len(word))
            changed = set()
            for d, (name, a, b) in enumerate(zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if at := tail(name, b - a):
                    source[a + at[0] : b] = a + at[0] + np.arange(b - a - at[0]) % at[1]
                    changed.add(d)
            found = runs_of(word[source], bounds)
            rows = []
            for d, (name, text) in enumerate(zip(ids, data, strict=True)):
                runs, words = found.get(d, []), text.split()
                if d in changed:
                    words = [words[k] for k in (source[bounds[d] : bounds[d + 1]] - bounds[d]).tolist()]
                if runs:
                    words = [words[k] for k in np.flatnonzero(collapsed(len(words), runs)).tolist()]
                start, length, period = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                rows.append((name, len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

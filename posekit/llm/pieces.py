"""The fixed public piece vocabulary shared by language ID and n-best segmentation."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


class Pieces:
    """Pieces of a SentencePiece model: id by piece, score by id, byte pieces by byte.

    Pieces with the space mark after their first character (runs of blanks,
    which the model scores as never to be used) are left out, so that no piece
    crosses a word boundary.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        self.size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores = [0.0] * self.size
        self.bytes = [0] * 256
        self.texts = [model.id_to_piece(i) for i in range(self.size)]
        self.is_byte = [model.is_byte(i) for i in range(self.size)]
        for i, piece in enumerate(self.texts):
            self.scores[i] = model.get_score(i)
            if self.is_byte[i]:
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or SPACE in piece[1:]):
                self.ids[piece] = i
        self.longest = max(map(len, self.ids))
        self.points = np.array(self.scores)
        hashes = np.array([self._hash(p) for p in self.ids], np.uint64)
        order = np.argsort(hashes)
        self._hashes, self._found = hashes[order], np.array(list(self.ids.values()), np.int64)[order]
        self._heads = np.zeros(1 << _FILTER_BITS, bool)
        heads = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self._heads[np.array([self._hash(h) for h in heads], np.uint64) >> np.uint64(64 - _FILTER_BITS)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattices(self, words: list[str]) -> Lattices:
        """The lattices of many words. Substrings grow one character at a time while some piece may start so."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), size)
        stop = np.cumsum(size)[word] if len(word) else word
        at, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        starts, ends, ids = [], [], []
        for n in range(1, self.longest + 1):
            h = (h + code[at + n - 1] + np.uint64(1)) * _BASE
            k = np.minimum(np.searchsorted(self._hashes, h), len(self._hashes) - 1)
            hit = self._hashes[k] == h
            i = np.where(hit, self._found[k], -1)
            some = slice(None) if n == 1 else hit
            starts.append(at[some])
            ends.append(at[some] + n)
            ids.append(i[some])
            on = self._heads[h >> np.uint64(64 - _FILTER_BITS)] & (at + n < stop[at])
            at, h = at[on], h[on]
            if not len(at):
                break
        start, end, i = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
        return Lattices(self, words, size, word, start, end, i)


class Lattices:
    """Edges of many words over one line of nodes (a word of n characters has n + 1), by end offset, then word, then start.

    start, end: nodes; ids: pieces, the byte piece for a character spelled in
    one byte, -1 for one spelled in several.
    """

    def __init__(self, vocab: Pieces, words: list[str], size: np.ndarray, word: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray):
        self.vocab, self.words, self.size = vocab, words, size
        owner = word[start] if len(start) else start
        first = np.cumsum(size) - size
        offset = end - first[owner]
        order = np.lexsort((start, owner, offset))
        self.word, self.char = owner[order], start[order]
        self.start, self.end, self.ids = start[order] + self.word, end[order] + self.word, ids[order]
        self.first = first + np.arange(len(words))
        self.last = self.first + size
        self.longest = int(size.max()) if len(size) else 0
        self.cuts = np.searchsorted(offset[order], np.arange(1, self.longest + 2))
        self.spelled = np.flatnonzero(self.ids < 0)
        self.spelling: dict[int, list[int]] = {}
        text = "".join(words) if len(self.spelled) else ""
        for k in self.spelled.tolist():
            self.spelling[k] = [vocab.bytes[x] for x in text[self.char[k]].encode("utf-8", "surrogatepass")]
        one = np.array([k for k, v in self.spelling.items() if len(v) == 1], np.int64)
        self.ids[one] = [self.spelling[k][0] for k in one.tolist()]

    def steps(self, backward: bool = False):
        """Edges that end at offset 1, 2, ... (or the other way round) as slices."""
        spans = [slice(a, b) for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True) if a < b]
        return reversed(spans) if backward else spans


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)

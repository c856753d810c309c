"""Whole-text encoding with a public tokenizer, each distinct chunk of a batch encoded once.

Both tokenizers split a text at white space, and between a letter and
punctuation, before any merge. So a text cut before single blanks, around single
line feeds and between a letter and the punctuation after it gives the same ids
chunk by chunk. Prose repeats its words: the ids of chunks are kept in a table of
bounded size for the life of the Python worker; when it is full, chunks seen in
one batch only leave it. A text with any other white space, or with the string of
an added token (one id, by the library's default), is given to the tokenizer whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from posekit.llm.common import BASES, hashes, hold

#: Chunks kept at most (about 40 bytes each); what is over it is forgotten, which bounds memory and not results.
MAX_CHUNKS = 600_000
#: Punctuation before which a text is cut where a letter of the first Unicode blocks precedes.
TAIL = b".,#*%&$!?;:|"
#: In two bytes: the signs of times and division, and the dotted capital I, whose lower case ends in a mark.
NO_LETTERS = [0xC397, 0xC3B7, 0xC4B0]
_MARK = "\u0001"
JOINED = 100
_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}
#: White space other than blank and line feed.
STRANGE_SPACE = re.compile(r"[^\S \n]|[\x00-\x09\x0b-\x1f\x7f-\xa0]")
#: Kinds of bytes: ASCII letter, tail, lead of a two-byte letter, what may be strange white space.
_LETTER, _TAIL, _LEAD, _ODD = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(TAIL)] = _TAIL
_KIND[0xC3:0xCA] = _LEAD
_KIND[[*range(10), *range(11, 32), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = _ODD


class ChunkEncoder:
    """ids(texts): the ids of whole texts, as one flat array and the number of each."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer do not fit 16 bits")
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.drops_space = drops_space
        # What stands between joined chunks, and its one id.
        self.between, self.after = (f" {_MARK} ", f" {_MARK}") if drops_space else ("\n", "\n")
        self.mark = self._raw([self.after])[0][0]
        self._empty()

    def _empty(self) -> None:
        """Chunks known: two hashes (sorted by the first) and a number each; by number, where the ids are."""
        self.h1, self.h2, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.used, self.known = np.empty(1 << 16, np.uint16), 0, 0
        self.first, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.seen = np.zeros(1 << 12, np.int32)  # batches that held the chunk

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes. JOINED chunks go through the tokenizer as one text with marks between, which is cheaper."""
        sizes, flat = np.zeros(len(chunks), np.int64), []
        for a in range(0, len(chunks), JOINED):
            some = chunks[a : a + JOINED]
            ids = np.array(self._raw([self.between.join(some) + self.after])[0])
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(some):  # a chunk holds the mark itself
                got = self._raw(some)
                sizes[a : a + len(some)] = [len(x) for x in got]
                flat += [np.array(x, np.uint16) for x in got]
            else:
                sizes[a : a + len(some)] = np.diff(ends, prepend=-1) - 1
                flat.append(np.delete(ids, ends).astype(np.uint16))
        return np.concatenate(flat) if flat else np.zeros(0, np.uint16), sizes

    def _learn(self, names: list[bytes]) -> np.ndarray:
        """Numbers of new chunks."""
        chunks = b"\0".join(names).decode("utf-8").split("\0")
        if len(chunks) != len(names):  # a chunk holds a zero character
            chunks = [n.decode("utf-8") for n in names]
        text = "".join(chunks)
        check = self._is_odd if "  " in text or STRANGE_SPACE.search(text) else str.isspace
        odd = np.fromiter(map(check, chunks), bool, len(chunks))
        got = self._raw([chunks[k] for k in np.flatnonzero(odd)])
        out = np.empty(len(names), np.int64)
        out[odd] = self._add(np.array([i for x in got for i in x], np.uint16), np.array([len(x) for x in got], np.int64))
        out[~odd] = self._add(*self._encode([c for c, o in zip(chunks, odd.tolist(), strict=True) if not o]))
        return out

    @staticmethod
    def _is_odd(chunk: str) -> bool:
        """White space beyond one leading blank, or nothing at all: not to be joined with others."""
        rest = chunk[1:] if chunk[:1] == " " else chunk
        return not rest or rest.isspace() or (not rest.isalnum() and rest.split() != [rest])

    def _gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[code].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.first[code] - (ends - sizes), sizes)], sizes

    def _add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, k = self.known, len(sizes)
        while n + k > len(self.first):
            self.first, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.seen))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.size[n : n + k] = sizes
        self.first[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.seen[n : n + k] = 0
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known += k
        return np.arange(n, n + k)

    def _forget(self) -> None:
        """Keep the chunks seen in most batches, half of the table at most."""
        seen = self.seen[self.number]
        least = max(2, int(np.partition(seen, len(seen) - MAX_CHUNKS // 2)[len(seen) - MAX_CHUNKS // 2]) + 1) if len(seen) > MAX_CHUNKS // 2 else 2
        keep = seen >= least
        h1, h2, seen = self.h1[keep], self.h2[keep], seen[keep]
        ids = self._gather(self.number[keep])
        self._empty()
        self.h1, self.h2, self.number = h1, h2, self._add(*ids).astype(np.int32)
        self.seen[: len(seen)] = seen // 2

    def _found(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Numbers of chunks by their hashes, -1 for new ones."""
        if not len(self.h1):
            return np.full(len(h1), -1, np.int64)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), self.number[at], -1).astype(np.int64)

    def _codes(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Numbers of distinct chunks that lie one behind the other in data."""
        h1, h2 = (hashes(np.frombuffer(data, np.uint8), offsets, base) for base in BASES)
        code = self._found(h1, h2)
        if self.known + int((code < 0).sum()) > MAX_CHUNKS:
            self._forget()
            code = self._found(h1, h2)
        new = np.flatnonzero(code < 0)
        if len(new):
            code[new] = self._learn([data[a:b] for a, b in zip(offsets[new].tolist(), offsets[new + 1].tolist(), strict=True)])
            new = new[np.argsort(h1[new], kind="stable")]
            at = np.searchsorted(self.h1, h1[new])
            self.h1, self.h2, self.number = np.insert(self.h1, at, h1[new]), np.insert(self.h2, at, h2[new]), np.insert(self.number, at, code[new].astype(np.int32))
        self.seen[code] += 1
        return code

    def _cuts(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where chunks start."""
        kind = _KIND[buf]
        cut = buf == 32
        line = np.flatnonzero(buf == 10)
        cut[line] = True
        cut[line[line + 1 < len(buf)] + 1] = True
        tail = np.flatnonzero(kind[1:] == _TAIL) + 1
        before = kind[tail - 1] == _LETTER
        wide = tail[~before & (tail >= 2)]
        wide = wide[(buf[wide - 1] & 0xC0 == 0x80) & (kind[wide - 2] == _LEAD)]
        wide = wide[~np.isin(buf[wide - 2].astype(int) << 8 | buf[wide - 1], NO_LETTERS)]
        cut[tail[before]] = True
        cut[wide] = True
        cut[starts[starts < len(buf)]] = True
        return np.flatnonzero(cut)

    def _strange(self, texts: list[str], buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the texts that are not to be cut."""
        space = (buf == 32) | (buf == 10)
        twice = np.flatnonzero(space[1:] & space[:-1])
        ends = np.append(starts[1:], len(buf)) - 1
        doubtful = np.searchsorted(starts, np.flatnonzero(_KIND[buf] == _ODD), side="right") - 1
        doubtful = [k for k in np.unique(doubtful).tolist() if STRANGE_SPACE.search(texts[k])]
        within = np.searchsorted(starts, twice, side="right") == np.searchsorted(starts, twice + 1, side="right")
        return np.unique(np.concatenate([np.searchsorted(starts, twice[within], side="right") - 1, np.flatnonzero(buf[ends] == 32), np.array(doubtful, np.int64)]))

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        count = np.zeros(len(texts), np.int64)
        some = np.array([k for k, t in enumerate(texts) if t], np.int64)
        if not len(some):
            return np.zeros(0, np.uint16), count
        held = [texts[k] for k in some.tolist()]
        data = [t.encode("utf-8") for t in held]
        whole = [k for k, t in enumerate(held) if b"<|" in data[k] and self.added.search(t)]
        joined = b"".join(data)
        buf = np.frombuffer(joined, np.uint8)
        starts = np.cumsum([0, *map(len, data[:-1])])
        if not self.drops_space:
            whole = np.union1d(whole, self._strange(held, buf, starts)).astype(np.int64).tolist()
        cuts = self._cuts(buf, starts)
        # Chunks are told apart by Arrow, without a copy; only those distinct in the batch are looked up.
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(buf))), pa.py_buffer(joined)])
        if len(whole):
            bounds = np.searchsorted(cuts, np.append(starts, len(buf)))
            drop = np.zeros(len(cuts) + 1, np.int64)
            drop[bounds[whole]] += 1
            drop[bounds[np.array(whole) + 1]] -= 1
            stay = np.cumsum(drop[:-1]) == 0
            chunks, cuts = chunks.filter(pa.array(stay)), cuts[stay]
        chunks = chunks.dictionary_encode()
        names = chunks.dictionary
        offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
        code = self._codes(names.buffers()[2].to_pybytes()[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0])[chunks.indices.to_numpy()]
        flat, sizes = self._gather(code)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(cuts, np.append(starts, len(buf)))]
        n = np.diff(bounds)
        if len(whole):
            parts = np.split(flat, bounds[1:-1])
            for k in whole:
                parts[k] = np.array(self._raw([held[k]])[0], np.uint16)
            flat, n = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        count[some] = n
        return flat, count


def encoder(path: str, drops_space: bool) -> ChunkEncoder:
    """The encoder of this worker."""
    key = (path, drops_space)
    hold(f"chunks of {path}", _ENCODERS.clear)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, drops_space)
    return _ENCODERS[key]


def with_end(flat: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text's, and the sizes with it."""
    return np.insert(flat, np.cumsum(sizes), np.uint16(end_id)), sizes + 1

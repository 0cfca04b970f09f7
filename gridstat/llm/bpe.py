"""Token ids of whole texts by the ``tokenizers`` library, with a memo of text chunks.

A byte-level BPE file first splits a text into pieces and merges only within
them.  Some places always begin a new piece: a single space, or a single line
feed and the character behind it, between two visible characters; and a full
stop or comma behind a letter.  A text's ids are those of the chunks between such
places, one after the other, so each distinct chunk goes through the library
once and all the rest is array work on the UTF-8 bytes.  Chunks are found by
64-bit hashes and their bytes compared.  Other tokenizer files are applied to whole
texts.

The memo is a fixed-size open-addressing table of numbers beside the chunks' bytes:
it is bounded, starts anew when full, and a Python worker keeps it from task to task.
"""

from __future__ import annotations

import os

import numpy as np

from .arrowtext import Texts, same_spans, span_hashes

SLOTS = 1 << 21
#: Bytes of chunks that a memo keeps.
MOST_BYTES = 32 << 20
_GRAPHIC = np.array([0x21 <= b <= 0x7E or b >= 0x80 for b in range(256)])
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_STOP = np.array([b in b".," for b in range(256)])


def _visible(d: np.ndarray) -> np.ndarray:
    """Bytes of visible characters; bytes that could be of white space beyond ASCII don't count."""
    g = _GRAPHIC[d]
    if len(d) > 2:
        a, b = d[:-1], d[1:]
        for lead, nexts, size in ((0xC2, (0x85, 0xA0), 2), (0xE1, (0x9A, 0xA0), 3), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
            at = np.flatnonzero(a == lead)
            at = at[np.isin(b[at], nexts)]
            for k in range(size):
                g[np.minimum(at + k, len(g) - 1)] = False
    return g


def chunks(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the chunks, and each row's range of chunks."""
    d, n = t.data, len(t.data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(t.n + 1, np.int64)
    g = _visible(d)
    heads = t.off[:-1][np.diff(t.off) > 0]
    edge = np.zeros(n + 1, bool)  # the first byte of a row
    edge[heads] = True
    edge[n] = True
    between = np.zeros(n, bool)
    between[1:-1] = g[:-2] & g[2:]
    between &= ~edge[:-1] & ~edge[1:]
    lone = (d == 10) & between
    cut = ((d == 32) & between) | lone
    cut[1:] |= lone[:-1] | (_STOP[d[1:]] & _LETTER[d[:-1]])
    cut[heads] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    return start, end, np.searchsorted(start, t.off)


class Memo:
    """Byte strings to numbers from 0 on, in order of insertion: open addressing by 64-bit hashes, and the bytes to be sure."""

    def __init__(self, slots: int, most_bytes: int = MOST_BYTES):
        self.mask = np.uint64(slots - 1)
        self.keys, self.values, self.n, self.room = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0, slots // 2
        self.pool, self.at, self.most_bytes = np.empty(1 << 16, np.uint8), np.zeros(self.room + 1, np.int64), most_bytes

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number that each hash has, or -1."""
        out = np.full(len(h), -1, np.int32)
        pos = h & self.mask
        todo = np.arange(len(h))
        while len(todo):
            k = self.keys[pos]
            hit = k == h[todo]
            out[todo[hit]] = self.values[pos[hit]]
            on = ~hit & (k != 0)
            todo, pos = todo[on], (pos[on] + np.uint64(1)) & self.mask
        return out

    def full(self, strings: int, size: int) -> bool:
        """Would so many more strings and bytes be too many?"""
        return self.n + strings > self.room or self.at[self.n] + size > self.most_bytes

    def insert(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Distinct hashes that have no number yet, and the ranges of ``data`` they are of."""
        size = end - start
        used = int(self.at[self.n])
        need = used + int(size.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[:used], np.empty(max(need, 2 * len(self.pool)) - used, np.uint8)])
        self.pool[used:need] = data[_ranges(start, size)]
        self.at[self.n + 1 : self.n + 1 + len(h)] = used + np.cumsum(size)
        value = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        pos = h & self.mask
        while len(h):
            free = self.keys[pos] == 0
            self.keys[pos[free]] = h[free]
            won = free & (self.keys[pos] == h)
            self.values[pos[won]] = value[won]
            h, value, pos = h[~won], value[~won], (pos[~won] + np.uint64(1)) & self.mask

    def holds(self, number: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Is the string of this number the range of ``data``?"""
        size = end - start
        own = self.at[number + 1] - self.at[number] == size
        return own & same_spans(self.pool[: self.at[self.n]], self.at[number], data, start, np.where(own, size, 0))


def spans_hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges that a ``Memo`` takes: none is 0."""
    return np.maximum(span_hashes(data, start, end), np.uint64(1))


class Encoder:
    def __init__(self, path: str, slots: int = SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        pre = self.tok.pre_tokenizer
        self.chunked = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tok.normalizer is None and self.tok.truncation is None
        self.slots = slots
        self._clear()
        # the same model on words that are spelled in the file's alphabet already
        self.spelled = Tokenizer(self.tok.model)
        self.spelled.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _clear(self) -> None:
        self.table = Memo(self.slots)
        self.pool, self.used = np.empty(1 << 18, np.uint32), 0
        self.at = np.zeros(self.slots // 2 + 1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after the other, and how many each has."""
        count = np.zeros(len(words), np.int64)
        word = [i for i, w in enumerate(words) if (b := w[1:] if w[0] == " " else w).isalpha() and max(b) < "ɐ"]
        ids = []
        for k in range(0, len(word), 256):
            own = word[k : k + 256]
            e = self.spelled.encode(" ".join([words[i].encode().decode("latin-1").translate(self.alphabet) for i in own]), add_special_tokens=False)
            count[own] = np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(own))
            ids.append(np.asarray(e.ids, np.uint32))
        rest = sorted(set(range(len(words))).difference(word))
        for i, x in zip(rest, self._whole([words[i] for i in rest]), strict=True):
            count[i] = len(x)
            ids.append(x)
        order = word + rest
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        end = np.cumsum(count[order])
        start = np.empty(len(words), np.int64)
        start[order] = end - count[order]
        return flat[_ranges(start, count)], count

    def _learn(self, t: Texts, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        h, first = np.unique(h, return_index=True)
        raw = t.data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        ids, count = self._distinct(words)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(ids), len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        n = self.table.n
        self.at[n + 1 : n + 1 + len(h)] = self.used + np.cumsum(count)
        self.used += len(ids)
        self.table.insert(h, t.data, start[first], end[first])

    def _plainly(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        raw = t.data.tobytes()
        ids = self._whole([raw[a:b].decode() for a, b in zip(t.off[:-1].tolist(), t.off[1:].tolist(), strict=True)])
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice as unsigned 32-bit integers, and where each row's begin (one more entry than rows)."""
        if not self.chunked:
            return self._plainly(t)
        start, end, rows = chunks(t)
        h = spans_hashed(t.data, start, end)
        v = self.table.find(h)
        new = np.flatnonzero(v < 0)
        if self.table.full(len(new), int((end - start)[new].sum())):
            self._clear()
            new = np.arange(len(h))
            if self.table.full(len(h), len(t.data)):
                return self._plainly(t)
        if len(new):
            self._learn(t, start[new], end[new], h[new])
            v[new] = self.table.find(h[new])
        if not self.table.holds(v, t.data, start, end).all():  # two chunks with one hash
            return self._plainly(t)
        count = self.at[v + 1] - self.at[v]
        off = np.concatenate([[0], np.cumsum(count)])
        return self.pool[_ranges(self.at[v], count)], off[rows]


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id behind each row's."""
    return np.insert(ids, off[1:], np.uint32(end_id)).astype("<u4"), off + np.arange(len(off))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

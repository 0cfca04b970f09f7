"""Token counts of a unigram vocabulary without making the tokens.

Aho-Corasick enumerates every vocabulary match in a word; dynamic programming
carries the best score to each place and the pieces on that path.  Ties are
decided as unigram tokenizers do: of paths to one place the first one stays unless
a later one is strictly better, and starts are tried from left to right, so the
longest last piece wins.  A character that no single-character piece covers may be
passed at the least score of the vocabulary minus 10, and counts one piece for each
of its UTF-8 bytes (byte fallback).

Words are what a space-marking pre-tokenizer gives: spaces become U+2581, a text
gets one in front unless it has one, and each mark starts a word.  Each distinct
word is counted once by a Python worker that keeps it in a bounded table; words are
found by 64-bit hashes and their bytes compared.

Defined cases: null and empty texts have no tokens; a null doc_id is carried;
repeated rows are counted each; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Words, texts
from .bpe import Memo

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SLOTS = 1 << 21
_SPACE = np.arange(1, 257, dtype=np.uint16)
_SPACE[0x20] = 0


def load_vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}


class Counter:
    """Counts pieces by one vocabulary; keeps what it has counted."""

    def __init__(self, vocabulary: dict[str, float], slots: int = SLOTS):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min(vocabulary.values()) - UNKNOWN_PENALTY
        self.slots = slots
        self.mark = self.word(MARK)
        self._clear()

    def _clear(self) -> None:
        self.table = Memo(self.slots)
        self.counts, self.scores = np.zeros(self.slots // 2, np.int32), np.zeros(self.slots // 2)

    def word(self, word: str) -> tuple[int, float]:
        """Pieces on the best path through one word, and its score."""
        n = len(word)
        score: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        at, best, pieces, single = 0, None, 0, False  # at: the place whose matches are being gathered

        def close() -> None:
            nonlocal best, pieces
            if not single and (best is None or score[at - 1] + self.unknown > best):
                best, pieces = score[at - 1] + self.unknown, count[at - 1] + len(word[at - 1].encode())
            score[at], count[at] = best, pieces

        for end, (size, value) in self.auto.iter(word):
            while at <= end:
                if at:
                    close()
                at, best, pieces, single = at + 1, None, 0, False
            start = at - size
            now = score[start] + value
            if best is None or now > best:
                best, pieces = now, count[start] + 1
            single = single or size == 1
        while at <= n:
            if at:
                close()
            at, best, pieces, single = at + 1, None, 0, False
        return count[n], score[n]

    def _learn(self, t, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        h, first = np.unique(h, return_index=True)
        got = [self.word(MARK + raw[a:b].decode()) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        n = self.table.n
        self.counts[n : n + len(h)] = [c for c, _ in got]
        self.scores[n : n + len(h)] = [s for _, s in got]
        self.table.insert(h, t.data, start[first], end[first])

    def count(self, t) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each row of a slice of texts."""
        w = Words(t, _SPACE)
        h = np.maximum(w.hash, np.uint64(1))
        v = self.table.find(h)
        new = np.flatnonzero(v < 0)
        if self.table.full(len(new), int((w.end - w.start)[new].sum())):
            self._clear()
            v[:], new = -1, np.arange(len(h))
        raw = t.data.tobytes() if len(new) else b""
        counts, scores = np.zeros(len(h), np.int64), np.zeros(len(h))
        plain: list[int] = []

        def look_up(own: np.ndarray) -> None:
            at = self.table.find(h[own])
            counts[own], scores[own] = self.counts[at], self.scores[at]
            plain.extend(own[~self.table.holds(at, t.data, w.start[own], w.end[own])].tolist())  # two words with one hash

        look_up(np.flatnonzero(v >= 0))
        for k in range(0, len(new), self.table.room):
            part = new[k : k + self.table.room]
            if k:
                self._clear()
            self._learn(t, raw, w.start[part], w.end[part], h[part])
            look_up(part)
        for i in plain:
            counts[i], scores[i] = self.word(MARK + t.data[w.start[i] : w.end[i]].tobytes().decode())
        total = np.bincount(w.row, counts, t.n).astype(np.int64)
        score = np.bincount(w.row, scores, t.n)
        # marks that stand alone: spaces (and the mark in front) that no word follows
        spaces = np.concatenate([[0], np.cumsum(t.data == 0x20)])
        lead = np.diff(t.off) > 0
        lead[lead] = t.data[t.off[:-1][lead]] != 0x20
        alone = spaces[t.off[1:]] - spaces[t.off[:-1]] + lead - np.diff(w.off)
        return total + alone * self.mark[0], score + alone * self.mark[1]


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and score of every text, by the vocabulary in ``path`` (at the same place on all executors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(load_vocabulary(path))
        counter = _counters[path]
        for b in batches:
            for t in texts(b.column(1)):
                n, s = counter.count(t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, t.n), pa.array(n), pa.array(s)], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")

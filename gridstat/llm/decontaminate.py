"""Benchmark decontamination by a positional inverted index of the training texts.

The index is split by documents: a segment holds some consecutive documents'
postings (word positions by term) of its own, so no term's posting list ever
comes together in one place and a very common word does no harm.  It is written
once, holds every term, and answers any number of questions.  Benchmark windows
go to the segments: each window waits under the term that is rarest among the
benchmark's own windows, and a segment touches only those whose term it holds.
For all of these together it intersects the lists, shifted by each term's place in
the window, from the term that is rarest in the segment on.  Nothing but the
answers leaves a segment.

Benchmark items are a query set: they are read in blocks of at most
``BLOCK_WORDS`` words (a longer item is dealt over several, with windows' overlap),
and a block is let go when its answers are written.  Words are compared by 64-bit
hashes.

Defined cases: a null or empty text has no words and no hits; an item without
words asks for nothing; items with one item_id count once, and a null item_id
counts as the empty string; a null doc_id is carried; repeated rows are answered
each on its own; empty tables give no rows or no hits; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstat.sources.scratch import discard, stash

from .arrowtext import Texts, Words, alnum_table, new_key, texts

WINDOW = 13
BLOCK_WORDS = 500_000
#: Places of windows that are followed at once.
_PLACES = 1 << 20
SHARE = 20
INDEX_SCHEMA = "seg string, doc_ids array<long>, n_words array<int>, terms binary, starts binary, postings binary"
ANSWER_SCHEMA = "seg string, row int, doc_id long, n_words long, spans array<int>, items array<string>"


def _hashes(words: list[str], key: np.uint64 = np.uint64(0)) -> list[np.ndarray]:
    """The word hashes of each text."""
    out: list[np.ndarray] = []
    table = alnum_table()
    for t in texts(pa.array(words, pa.string())):
        w = Words(t, table, key)
        out += [w.hash[a:b] for a, b in zip(w.off[:-1], w.off[1:], strict=True)]
    return out


class Block:
    """Windows of some benchmark items: their term numbers by size of window, under each window's rarest term, and the item that each is of."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.names = [item for item, _ in items]
        words = np.concatenate([np.empty(0, np.uint64), *(h for _, h in items)])
        self.terms, number = np.unique(words, return_inverse=True)
        often = np.bincount(number, minlength=len(self.terms))
        by: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        at = 0
        for i, (_, h) in enumerate(items):
            own, at = number[at : at + len(h)], at + len(h)
            if size := min(window, len(h)):
                w = np.lib.stride_tricks.sliding_window_view(own.astype(np.int32), size)
                both = by.setdefault(size, ([], []))
                both[0].append(w)
                both[1].append(np.full(len(w), i, np.int32))
        #: size: (windows sorted by their rarest term, items, where each term's windows begin)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, (ws, owners) in by.items():
            w, owner = np.concatenate(ws), np.concatenate(owners)
            rare = w[np.arange(len(w)), np.argmin(often[w], axis=1)]
            order = np.argsort(rare, kind="stable")
            self.windows[size] = (w[order], owner[order], np.concatenate([[0], np.cumsum(np.bincount(rare, minlength=len(self.terms)))]))


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS, key: np.uint64 = np.uint64(0)) -> Iterator[Block]:
    """The benchmark's items in blocks of bounded size, at least one; a block goes to the tasks as a whole.  ``key`` is that of the index."""
    most = max(most, 2 * window)
    held, size, any_ = [], 0, False
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator()
    for item, text in rows:
        h = _hashes([text or ""], key)[0]
        step = most - window + 1
        for part in [h[i : i + most] for i in range(0, max(len(h) - window + 1, 1), step)] if len(h) else []:
            if held and size + len(part) > most:
                yield Block(held, window)
                held, size, any_ = [], 0, True
            held.append((item, part))
            size += len(part)
    if held or not any_:
        yield Block(held, window)


def _postings(t: Texts, table: np.ndarray, key: np.uint64) -> dict:
    w = Words(t, table, key)
    kept, inv = np.unique(w.hash, return_inverse=True)
    order = np.argsort(inv.astype(np.int32), kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(inv, minlength=len(kept)))]).astype("<u4")
    return {"n_words": np.diff(w.off), "terms": kept.astype("<u8"), "starts": starts, "postings": order.astype("<u4")}


def build_index(docs: DataFrame, key: np.uint64 = np.uint64(0)) -> DataFrame:
    """Segments with the postings of all terms, by their hashes under ``key``: questions must have the same one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, n, part = alnum_table(), 0, TaskContext.get().partitionId()
        for b in batches:
            ids = b.column(0)
            for t in texts(b.column(1)):
                p = _postings(t, table, key)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{part}:{n}"]),
                        pa.array([ids.slice(t.first, t.n).to_pylist()], pa.list_(pa.int64())),
                        pa.array([p["n_words"].astype(np.int32)], pa.list_(pa.int32())),
                        *(pa.array([p[k].tobytes()], pa.binary()) for k in ("terms", "starts", "postings")),
                    ],
                    ["seg", "doc_ids", "n_words", "terms", "starts", "postings"],
                )
                n += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX_SCHEMA)


class Segment:
    """One segment's lists, asked for phrases and for nearness."""

    def __init__(self, n_words: np.ndarray, terms: bytes, starts: bytes, postings: bytes):
        self.off = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        self.terms, self.starts = np.frombuffer(terms, "<u8"), np.frombuffer(starts, "<u4").astype(np.int64)
        self.postings = np.frombuffer(postings, "<u4").astype(np.int64)

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """This segment's number of each term, -1 where it has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def list(self, k: int) -> np.ndarray:
        return self.postings[self.starts[k] : self.starts[k + 1]]

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows (rows of this segment's term numbers) stand in one document each: the window's row, and the place."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = windows.shape[1] if len(windows) else 0
        long = (self.starts[windows + 1] - self.starts[windows]) if len(windows) else np.empty((0, 0), np.int64)
        order = np.argsort(long, axis=1, kind="stable")
        # a list's entries with their term in front are in order over all lists
        keyed = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, np.diff(self.starts)) | self.postings
        first = long[np.arange(len(windows)), order[:, 0]] if len(windows) else np.empty(0, np.int64)
        ends = np.cumsum(first)
        at = 0
        while at < len(windows):
            end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PLACES, "right")), at + 1)
            w, o = windows[at:end], order[at:end]
            n = first[at:end]
            row = np.repeat(np.arange(len(w)), n)
            rarest = w[np.arange(len(w)), o[:, 0]]
            place = self.postings[np.repeat(self.starts[rarest] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] - o[row, 0]
            ok = (place >= 0) & (place + size <= self.off[-1])
            row, place = row[ok], place[ok]
            for k in range(1, size):
                if not len(row):
                    break
                j = o[row, k]
                want = (w[row, j].astype(np.int64) << 32) | (place + j)
                i = np.minimum(np.searchsorted(keyed, want), len(keyed) - 1)
                ok = keyed[i] == want
                row, place = row[ok], place[ok]
            doc = np.searchsorted(self.off, place, "right") - 1
            ok = place + size <= self.off[doc + 1] if len(place) else np.empty(0, bool)
            found.append((row[ok] + at, place[ok]))
            at = end
        return tuple(np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1))

    def phrase(self, numbers: np.ndarray) -> np.ndarray:
        """Where the terms stand one after the other in one document."""
        return self.phrases(np.asarray(numbers)[None, :])[1]

    def near(self, numbers: np.ndarray, slop: int) -> np.ndarray:
        """Places of the rarest term that have every other term within ``slop`` words in the same document."""
        order = np.argsort(self.starts[numbers + 1] - self.starts[numbers], kind="stable")
        at = self.list(numbers[order[0]])
        for j in order[1:]:
            row = np.searchsorted(self.off, at, "right") - 1
            low, high = np.maximum(at - slop, self.off[row]), np.minimum(at + slop + 1, self.off[row + 1])
            p = self.list(numbers[j])
            at = at[np.searchsorted(p, low) < np.searchsorted(p, high)]
        return at


def _search(seg: Segment, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, word behind the last and item number of every window that stands in a document."""
    numbers = seg.numbers(block.terms)
    held = np.flatnonzero(numbers >= 0)
    out = []
    for size, (windows, owner, starts) in block.windows.items():
        n = starts[held + 1] - starts[held]
        own = np.repeat(starts[held] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        k = numbers[windows[own]]
        own, k = own[(k >= 0).all(axis=1)], k[(k >= 0).all(axis=1)]
        which, at = seg.phrases(k)
        row = np.searchsorted(seg.off, at, "right") - 1
        at = at - seg.off[row] if len(at) else at
        out.append((row, at, at + size, owner[own[which]]))
    return tuple(np.concatenate([np.empty(0, np.int64), *(x[i] for x in out)]).astype(np.int64) for i in range(4))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _answers(batches: Iterator[pa.RecordBatch], block: Block, every: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            name, ids, n_words = (b.column(c)[i].as_py() for c in range(3))
            row, start, end, item = _search(Segment(np.array(n_words, np.int64), *(b.column(c)[i].as_buffer() for c in (3, 4, 5))), block)
            by: dict[int, tuple[set[tuple[int, int]], set[int]]] = {}
            for r, a, z, k in zip(row.tolist(), start.tolist(), end.tolist(), item.tolist(), strict=True):
                spans, items = by.setdefault(r, (set(), set()))
                spans.add((a, z))
                items.add(k)
            rows = list(range(len(ids))) if every else sorted(by)
            none: tuple[set, set] = (set(), set())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(rows), pa.string()),
                    pa.array(rows, pa.int32()),
                    pa.array([ids[r] for r in rows], pa.int64()),
                    pa.array([n_words[r] for r in rows], pa.int64()),
                    pa.array([[x for s in merged(by.get(r, none)[0]) for x in s] for r in rows], pa.list_(pa.int32())),
                    pa.array([sorted({block.names[k] for k in by.get(r, none)[1]}) for r in rows], pa.list_(pa.string())),
                ],
                ["seg", "row", "doc_id", "n_words", "spans", "items"],
            )


def search(index: DataFrame, block: Block, every: bool = True) -> DataFrame:
    """The hit spans (from, to, from, to ...) and the items that occur, of every document, or of those with any."""
    return index.mapInArrow(lambda batches: _answers(batches, block, every), ANSWER_SCHEMA)


def near(index: DataFrame, words: list[str], slop: int, key: np.uint64 = np.uint64(0)) -> DataFrame:
    """Documents and places (of the rarest of ``words``) with all of them within ``slop`` words of it."""
    terms = np.array([h[0] for h in _hashes(words, key)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ids, n_words, t, starts, postings in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Segment(np.array(n_words, np.int64), t, starts, postings)
                numbers = s.numbers(terms)
                at = s.near(numbers, slop) if (numbers >= 0).all() else np.empty(0, np.int64)
                row = np.searchsorted(s.off, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in row], pa.int64()), pa.array(at - s.off[row])], ["doc_id", "position"])

    return index.mapInArrow(run, "doc_id long, position long")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS, digest: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans of hit words and the items found, over all blocks of the benchmark; or their digests."""
    key = new_key()
    index = stash(build_index(docs, key), "postings", **{"parquet.block.size": 16 << 20, "compression": "zstd"})
    asked = blocks(benchmark, window, most, key)
    block, later = next(asked), next(asked, None)
    if later is None:
        if digest:  # in the same worker
            return index.mapInArrow(lambda batches: map(_digested, _answers(batches, block, True)), DIGEST_SCHEMA)
        return search(index, block).select("doc_id", "n_words", "spans", "items")
    found = stash(search(index, block), "answers")
    while later is not None:
        more = stash(search(index, later, every=False), "answers")
        # at most one row of each block for a document of the index
        both = found.unionByName(more).groupBy("seg", "row").agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
        old, found = found, stash(both, "answers")
        discard(old, more)
        later = next(asked, None)
    return found.mapInArrow(lambda batches: map(_digested, batches), DIGEST_SCHEMA) if digest else found.drop("seg", "row")


DIGEST_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digested(b: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of answers as digests."""
    hits, counts, shas = [], [], []
    for s, i in zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
        hits.append(sum(z - a for a, z in merged(list(zip(s[::2], s[1::2], strict=True)))) if s else 0)
        own = sorted(set(i))
        counts.append(len(own))
        shas.append(hashlib.sha256(",".join(own).encode()).hexdigest())
    n, h = b.column("n_words").to_numpy(zero_copy_only=False), np.array(hits, np.int64)
    cols = [b.column("doc_id"), b.column("n_words"), pa.array(h), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array((h > 0) & (SHARE * h >= n))]
    return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in DIGEST_SCHEMA.split(", ")])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs, from its matches."""
    return matches(docs, benchmark, window, most, digest=True)

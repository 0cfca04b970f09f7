"""Harmonic packing of token sequences into rows of fixed capacity.

A document's remainder r modulo the capacity C falls into the class k = C // r:
lengths in (C / (k + 1), C / k].  A bin of class k takes exactly k remainders,
so classes need nothing of each other and neither do tasks.  What harmonic bins
leave empty is filled from a stream of the tokens that may be cut: the documents'
whole multiples of C and the remainders of unfinished bins.  If the stream is
too short, the emptiest bins are dissolved into it.  The rest of the stream is
cut at C; its last part, below C, into powers of two, which need no padding.

Each task packs its rows in chunks of about 2 MB of text: memory is
bounded by a chunk (or one longer text), and no row is shuffled.

Defined cases: null and empty texts are the separator id alone; a null doc_id is
carried; repeated rows are packed each on its own; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import texts
from .bpe import encoder, with_end

CAPACITY = 1024
SEPARATOR_ID = 0
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan(lengths: np.ndarray, cap: int = CAPACITY) -> dict[str, np.ndarray]:
    """Pieces (doc, start, length, sequence, offset) for documents of these lengths, each at least 1."""
    n = np.asarray(lengths, np.int64)
    rest, whole = n % cap, n - n % cap
    small = np.flatnonzero(rest)
    k = cap // rest[small]
    order = np.argsort(k, kind="stable")
    small, k = small[order], k[order]
    first = np.searchsorted(k, k)
    rank = np.arange(len(k)) - first
    count = np.searchsorted(k, k, "right") - first
    closed = rank < count // np.maximum(k, 1) * k
    # bins of complete groups, in order of class
    doc, kc = small[closed], k[closed]
    head = (rank[closed] % kc) == 0
    bin_of = np.cumsum(head) - 1
    n_bins = int(head.sum())
    size = np.bincount(bin_of, rest[doc], n_bins).astype(np.int64)
    # fullest bins first; as many stay as the stream and the dissolved ones can fill
    by = np.argsort(cap - size, kind="stable")
    slack, content = (cap - size)[by], size[by]
    loose = whole.sum() + rest[small[~closed]].sum()
    keep = int(np.count_nonzero(np.cumsum(slack) <= loose + content.sum() - np.cumsum(content)))
    place = np.empty(n_bins, np.int64)
    place[by] = np.arange(n_bins)
    seq = place[bin_of]
    stay = seq < keep
    before = np.cumsum(rest[doc]) - rest[doc]
    offset = before - (before[head])[bin_of] if n_bins else before
    out = [np.stack([doc[stay], whole[doc[stay]], rest[doc[stay]], seq[stay], offset[stay]])]
    # the stream of cuttable tokens
    extra = np.concatenate([small[~closed], doc[~stay]])
    long = np.flatnonzero(whole)
    s_doc = np.concatenate([extra, long])
    s_start = np.concatenate([whole[extra], np.zeros(len(long), np.int64)])
    s_len = np.concatenate([rest[extra], whole[long]])
    total = int(s_len.sum())
    if total:
        gaps = np.flatnonzero(slack[:keep])
        left = total - int(slack[:keep].sum())
        tail = [1 << b for b in range(left % cap) if left % cap >> b & 1][::-1] if left % cap else []
        t_len = np.concatenate([slack[gaps], np.full(left // cap, cap), np.array(tail, np.int64)]).astype(np.int64)
        t_seq = np.concatenate([gaps, keep + np.arange(len(t_len) - len(gaps))])
        t_off = np.concatenate([content[gaps], np.zeros(len(t_len) - len(gaps), np.int64)])
        s_end, t_end = np.cumsum(s_len), np.cumsum(t_len)
        end = np.union1d(s_end, t_end)
        start = np.concatenate([[0], end[:-1]])
        s, t = np.searchsorted(s_end, start, "right"), np.searchsorted(t_end, start, "right")
        out.append(np.stack([s_doc[s], s_start[s] + start - (s_end - s_len)[s], end - start, t_seq[t], t_off[t] + start - (t_end - t_len)[t]]))
    return dict(zip(("doc", "start", "length", "sequence", "offset"), np.concatenate(out, axis=1), strict=True))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator_id: int = SEPARATOR_ID, with_ids: bool = False) -> DataFrame:
    """Every document's pieces; ``with_ids`` adds each piece's ids as ``array<int>``."""

    names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, seq = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for b in batches:
            for t in texts(b.column(1)):
                ids, off = with_end(*enc.encode(t), separator_id)
                n = np.diff(off)
                p = plan(n, capacity)
                at = off[p["doc"]] + p["start"]
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * (i + m)]) for i, m in zip(at.tolist(), p["length"].tolist(), strict=True)]
                doc = b.column(0).slice(t.first, t.n).take(pa.array(p["doc"]))
                cols = [doc, pa.array(p["start"]), pa.array(p["length"]), pa.array(crc, pa.int64()), pa.array(n[p["doc"]]), pa.array(p["sequence"] + seq), pa.array(p["offset"])]
                if with_ids:
                    cols.append(pa.array([ids[i : i + m] for i, m in zip(at.tolist(), p["length"].tolist(), strict=True)], pa.list_(pa.int32())))
                seq += int(p["sequence"].max()) + 1
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))

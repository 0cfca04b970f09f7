"""Token-ID output: patched frame-of-reference blocks in a file format of its own.

A *segment* is one self-contained file image of the ids of some consecutive whole
documents, about 2 MB of text (more only where one text is longer)::

    "PFR1"  u32 documents  u64 ids  u32 block length  u32 blocks
    i64 x documents: doc_id     u8 x documents: doc_id is null     u32 x documents: ids of each
    u64 x (blocks + 1): where each block starts
    blocks: u32 minimum, u8 width, u8 0, u16 exceptions,
            the offsets from the minimum, ``width`` bits each, in 32-bit words,
            u16 x exceptions: position, u32 x exceptions: whole offset

The width of a block is the bits that hold its 90th-percentile offset; larger
offsets are exceptions.  All numbers are little-endian.  The index of block
starts lets a reader decode one document without the rest (``read_range``).

Segments are written as rows of a Parquet table: Spark commits them task by task,
so a lost executor leaves no half-written file, and any store that Spark reaches
will do.  ``payload`` of a row is the file image; ``part``, ``seq`` give their
order, ``local_start`` the ids before it in its part.

Defined cases: null and empty texts have the end id alone; rows with equal doc_id
stay separate, in order of a hash of their text, and may lie in several parts; a null
doc_id sorts first and stays null; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstat.sources.scratch import new_path, stash

from .arrowtext import texts
from .bpe import encoder, with_end

BLOCK = 512
PERCENTILE = 0.9
END_ID = 2
PARTS = 1024
_HEAD = struct.Struct("<4sIQII")
_BLOCK = struct.Struct("<IBBH")
SEGMENT_SCHEMA = "part int, seq int, local_start long, n_ids long, n_docs int, payload binary"


def _lanes(width: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    bit = np.arange(n) * width
    return bit >> 5, bit & 31, (n * width + 31) >> 5


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of offsets below 2**width to rows of 32-bit words."""
    n = low.shape[1]
    word, shift, size = _lanes(width, n)
    out = np.zeros((size + 1, len(low)), np.uint64)
    cols = np.ascontiguousarray(low.T).astype(np.uint64)
    for i in range(n):
        v = cols[i] << np.uint64(shift[i])
        out[word[i]] |= v & np.uint64(0xFFFFFFFF)
        if shift[i] + width > 32:
            out[word[i] + 1] |= v >> np.uint64(32)
    return np.ascontiguousarray(out[:size].T).astype("<u4")


def _unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    word, shift, size = _lanes(width, n)
    cols = np.zeros((size + 1, len(words)), np.uint64)
    cols[:size] = words.T
    out = np.empty((n, len(words)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(n):
        v = cols[word[i]] >> np.uint64(shift[i])
        if shift[i] + width > 32:
            v = v | (cols[word[i] + 1] << np.uint64(32 - shift[i]))
        out[i] = v & mask
    return np.ascontiguousarray(out.T)


def encode_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ids (unsigned 32-bit); the last one may be short."""
    full = len(ids) // block
    out: list[bytes] = []
    for v in ([ids[: full * block].reshape(full, block)] if full else []) + ([ids[full * block :].reshape(1, -1)] if len(ids) % block else []):
        n = v.shape[1]
        low = v.min(axis=1)
        off = (v - low[:, None]).astype(np.uint32)
        k = max(0, int(np.ceil(percentile * n)) - 1)
        at = np.partition(off, k, axis=1)[:, k]
        width = np.where(at == 0, 0, np.floor(np.log2(np.maximum(at, 1).astype(np.float64))).astype(np.int64) + 1)
        limit = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
        over = off > limit[:, None]
        rows: list[bytes] = [b""] * len(v)
        for w in np.unique(width):
            sel = np.flatnonzero(width == w)
            words = _pack(np.where(over[sel], 0, off[sel]), int(w)) if w else np.zeros((len(sel), 0), "<u4")
            for i, x in zip(sel, words, strict=True):
                pos = np.flatnonzero(over[i])
                rows[i] = _BLOCK.pack(int(low[i]), int(w), 0, len(pos)) + x.tobytes() + pos.astype("<u2").tobytes() + off[i][pos].astype("<u4").tobytes()
        out += rows
    return out


def decode_blocks(blocks: list[memoryview], lengths: list[int]) -> np.ndarray:
    heads = [_BLOCK.unpack_from(b) for b in blocks]
    base = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    out = np.empty(base[-1], np.uint32)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault((h[1], lengths[i]), []).append(i)
    for (w, n), sel in groups.items():
        size = (n * w + 31) >> 5
        if w:
            words = np.stack([np.frombuffer(blocks[i], "<u4", size, _BLOCK.size) for i in sel])
            off = _unpack(words, w, n)
        else:
            off = np.zeros((len(sel), n), np.uint32)
        for row, i in zip(off, sel, strict=True):
            low, _, _, k = heads[i]
            if k:
                at = _BLOCK.size + 4 * size
                row[np.frombuffer(blocks[i], "<u2", k, at)] = np.frombuffer(blocks[i], "<u4", k, at + 2 * k)
            out[base[i] : base[i] + n] = row + np.uint32(low)
    return out


def write_segment(doc_ids: list[int | None], flat: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> bytes:
    blocks = encode_ids(flat, block)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return b"".join(
        [
            _HEAD.pack(b"PFR1", len(lengths), len(flat), block, len(blocks)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            lengths.astype("<u4").tobytes(),
            starts.tobytes(),
            *blocks,
        ]
    )


class Segment:
    """A reader of one file image."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        magic, self.n_docs, self.n_ids, self.block, n_blocks = _HEAD.unpack_from(self.data)
        if magic != b"PFR1":
            raise ValueError("not a token file")
        at, n = _HEAD.size, self.n_docs
        self.doc_ids = np.frombuffer(self.data, "<i8", n, at)
        self.null = np.frombuffer(self.data, "u1", n, at + 8 * n).astype(bool)
        self.lengths = np.frombuffer(self.data, "<u4", n, at + 9 * n).astype(np.int64)
        at += 13 * n
        self.index = np.frombuffer(self.data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.body = at + 8 * (n_blocks + 1)

    def read_range(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1, decoding only the blocks that hold them."""
        if end <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block + 1
        lengths = [min(self.block, self.n_ids - i * self.block) for i in range(a, b)]
        cut = [self.data[self.body + self.index[i] : self.body + self.index[i + 1]] for i in range(a, b)]
        return decode_blocks(cut, lengths)[start - a * self.block : end - a * self.block]

    def read(self) -> np.ndarray:
        return self.read_range(0, self.n_ids)


#: Bytes of texts that a range holds about.
RANGE_BYTES = 256 << 20


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode every whole text, in ascending doc_id order, into segments at ``path``.

    One range shuffle puts the texts in order; tasks then encode and write on their own.  There are as many ranges as the
    session asks for, and more where these would hold more than ``RANGE_BYTES`` of texts each.
    Ranges may end between rows of one doc_id, and between equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        for b in batches:
            for t in texts(b.column(1)):
                ids, off = with_end(*enc.encode(t), end_id)
                payload = write_segment(b.column(0).slice(t.first, t.n).to_pylist(), ids, np.diff(off))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start]), pa.array([len(ids)]), pa.array([t.n], pa.int32()), pa.array([payload], pa.binary())],
                    [f.split()[0] for f in SEGMENT_SCHEMA.split(", ")],
                )
                seq, start = seq + 1, start + len(ids)

    order = ["doc_id", "_print", "_at"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_print"), F.monotonically_increasing_id().alias("_at"))
    held = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = -(-held // RANGE_BYTES)
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of our own is not coalesced where ranges are small, so the session's stays while it is enough
    dealt = rows.repartitionByRange(ranges, *order) if ranges > own else rows.repartitionByRange(*order)
    ordered = dealt.sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.option("parquet.block.size", 16 << 20).option("compression", "none").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    seg = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # a row for each part of the files; those before a part are added up in two steps, by hundreds of parts and within them
    part = seg.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("many", F.floor(F.col("part") / PARTS))
    inner = F.sum("n").over(Window.partitionBy("many").orderBy("part")) - F.col("n")
    many = part.groupBy("many").agg(F.sum("n").alias("all"), F.lit(0).alias("one"))
    outer = many.select("many", (F.sum("all").over(Window.partitionBy("one").orderBy("many")) - F.col("all")).alias("before"))
    base = stash(part.select("part", "many", inner.alias("inner")).join(outer, "many").select("part", (F.col("before") + F.col("inner")).alias("base")), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, at in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                s = Segment(payload.as_buffer())
                ids = s.read().astype("<u4")
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                raw = memoryview(ids).cast("B")
                crc = np.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, mask=s.null), pa.array(starts + at), pa.array(s.lengths), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = seg.join(base, "part").select("payload", (F.col("base") + F.col("local_start")).alias("at"))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the files (into the shared folder unless told where) and return what they hold."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, path, end_id)
    return read_token_files(docs.sparkSession, path)

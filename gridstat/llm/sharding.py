"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly, by seeded hashes, into buckets that fit in
memory; pass two puts each bucket in a canonical order, shuffles it by Fisher and
Yates with a generator seeded by the bucket, and writes it.  Buckets are parts of
shards, so a shard is its buckets one after the other; each shard is a folder that
can be read alone (``read_shards``).  Neighbouring buckets share a shuffle
partition, so that their number does not grow with that of the buckets.

The law is ``key``: a document's shard is the one, of all shards, whose seeded
hash with its doc_id is greatest.  So doc_id and the number of shards decide, and
one more shard takes rows only into itself.  Which bucket of its shard a record
falls into is decided by doc_id and text; a row that is repeated until it would
fill a bucket is dealt by its place in the input as well.

Defined cases: a null text has size 8 and the checksum of the empty text; a null
doc_id hashes as a value of its own; equal rows lie beside each other only by
chance; an empty table gives no rows.  Other columns are written with the records.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstat.sources.scratch import new_path, stash

SHARDS = 24
SEED = 8
BUCKET_BYTES = 8 << 20
#: About what a task of the second pass reads, where the input is large enough for all cores.
PARTITION_BYTES = 256 << 20
_OWN = ("shard", "bucket", "place", "grown_shard")


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the greatest hash (rendezvous hashing)."""
    key = F.coalesce(key.cast("string"), F.lit("\0"))
    weights = [F.struct(F.xxhash64(F.lit(f"{seed}/{i}"), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)]
    return F.greatest(*weights)["i"]


def _repeated(docs: DataFrame, key: Column, print_: Column, most: int) -> DataFrame:
    """A written table (key, print, cuts) of the rows whose copies have more than ``most`` bytes together."""
    g = docs.groupBy(key.alias("_key"), print_.alias("_print")).agg(F.sum(size_of()).alias("bytes"), F.count("*").alias("n"))
    return stash(g.filter((F.col("n") > 1) & (F.col("bytes") > most)).select("_key", "_print", F.ceil(F.col("bytes") / most).cast("int").alias("_cuts")), "repeated")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write all columns of docs, with bucket, place and grown_shard, as Parquet in a folder for each shard.

    Columns of these names in the input are replaced.
    """
    total = docs.agg(F.sum(size_of())).first()[0] or 0
    parts = max(1, -(-total // (shards * bucket_bytes)))  # buckets of a shard
    tasks = min(shards * parts, max(4 * docs.sparkSession.sparkContext.defaultParallelism, total // PARTITION_BYTES))
    own = [c for c in docs.columns if c not in _OWN]
    key, print_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.xxhash64(F.coalesce("text", F.lit("\0")))
    hot = _repeated(docs, key, print_, bucket_bytes // 2)
    rows = docs.select(*own, key.alias("_key"), print_.alias("_print")).withColumn("_at", F.monotonically_increasing_id()).join(hot, ["_key", "_print"], "left")
    sub = F.pmod(F.xxhash64(F.lit(f"{seed}/bucket"), "_key", "_print", F.coalesce(F.col("_at") % F.col("_cuts"), F.lit(0))), F.lit(parts))
    scattered = rows.select(*own, shard_of(F.col("doc_id"), shards, seed).alias("shard"), shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"), sub.alias("_sub"))
    scattered = scattered.withColumn("bucket", (F.col("shard") * parts + F.col("_sub")).cast("long")).drop("_sub")
    scattered = scattered.withColumn("_task", F.floor(F.col("bucket") * tasks / (shards * parts)).cast("int"))
    schema = scattered.drop("_task").withColumn("place", F.lit(0).cast("int")).schema

    def run(bucket: pa.Table) -> pa.Table:
        b = bucket.column("bucket")[0].as_py()
        order = np.lexsort([_ranks(bucket.column(c)) for c in ("text", "doc_id")])
        rng = np.random.Generator(np.random.PCG64(int.from_bytes(blake2b(f"{seed}/{b}".encode(), digest_size=8).digest(), "big")))
        order = order[_fisher_yates(len(order), rng)]
        return bucket.drop_columns(["_task"]).take(pa.array(order)).append_column(pa.field("place", pa.int32()), pa.array(np.arange(len(order), dtype=np.int32)))

    shuffled = scattered.repartition(tasks, "_task").groupBy("_task", "bucket").applyInArrow(run, schema)
    shuffled.write.option("parquet.block.size", 32 << 20).partitionBy("shard").parquet(path)


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Each value's place among the distinct ones; nulls are last."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    kept = column.drop_null()
    values = kept.to_numpy(zero_copy_only=False)
    _, inverse = np.unique(values, return_inverse=True)
    out = np.full(len(column), len(column), np.int64)
    out[~column.is_null().to_numpy(zero_copy_only=False)] = inverse
    return out


def _fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A permutation by swapping each place, from the last down, with one at or below it."""
    order = list(range(n))
    picks = rng.integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for i, j in zip(range(n - 1, 0, -1), picks, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def read_shards(spark: SparkSession, path: str, schema: T.StructType, shard: int | None = None) -> DataFrame:
    """The written records, with shard, bucket and place; of one shard only its folder is read."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if shard is None else rows.filter(F.col("shard") == shard)


def with_slots(rows: DataFrame, written: DataFrame) -> DataFrame:
    """``slot``: a row's place in its whole shard, gapless from 0; rows has any columns of the written records beside bucket and place.

    The table of bucket sizes, a row for each bucket of bounded size, is written first, so that the join broadcasts it only if it measures small.
    """
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = stash(counts.select("bucket", (F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("before")), "buckets")
    return rows.join(before, "bucket").withColumn("slot", F.col("before") + F.col("place")).drop("before")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write the shards and read them back: all columns, and shard, bucket, place and grown_shard."""
    path = path or new_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, seed, bucket_bytes)
    extra = T.StructType([T.StructField("grown_shard", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    return read_shards(docs.sparkSession, path, T.StructType(docs.drop(*_OWN).schema.fields + extra.fields))


def digests(written: DataFrame) -> DataFrame:
    """The written records' sizes, checksums and places; the texts are left behind before any join."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = written.select("doc_id", size_of().alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "bucket", "place", "grown_shard")
    return with_slots(small, written).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")

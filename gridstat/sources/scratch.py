"""Written intermediate tables in the folder that the cluster shares.

Plans that read an intermediate result more than once, or iterate, cut their
lineage here.  A Parquet table in the shared folder survives the loss of any
executor, is columnar (later steps read only the columns they need) and is
compressed, which a serialised RDD checkpoint is not.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("gridstat.scratch", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="gridstat-")
        spark.conf.set("gridstat.scratch", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridstat/{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back under its own schema."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


#: Seconds between collections that let Spark delete unused shuffles.
PAUSE = 5.0
_collected = 0.0


def discard(*stashed: DataFrame | None) -> None:
    """Delete stashed tables that nothing unwritten depends on any more, and let Spark delete the shuffles that made them.

    Spark removes a shuffle's files when the driver's garbage collector finds it unused, which an idle driver may put off for long.
    PySpark has no call of its own for deleting a table's files; where the session has no JVM gateway (Spark Connect) they stay.
    """
    global _collected
    last = None
    for df in stashed:
        if (path := getattr(df, "stash_path", None)) and hasattr(df.sparkSession, "_jvm"):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p.getParent(), True)
            last = df
    if last is not None and time.monotonic() - _collected > PAUSE:
        _collected = time.monotonic()
        gc.collect()
        last.sparkSession._jvm.System.gc()

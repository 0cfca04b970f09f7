"""Where Python workers find this package, and how much they are handed at once."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Arrow batches may hold whole texts: a session that still has Spark's own limits gets smaller ones.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}
ROOT = str(Path(__file__).resolve().parents[2])


def reach(spark: SparkSession) -> None:
    """Let workers that start from now on import this package from the driver's place.

    It serves local sessions and clusters where the code lies at one path; elsewhere ship the package with ``addPyFile``.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *have]))
    for key, (default, small) in BATCH_LIMITS.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, small)

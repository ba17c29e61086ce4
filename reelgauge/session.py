"""Session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Runtime SQL settings.  All of them can be changed on a live session.
RUNTIME_CONF = {
    # every timestamp in the data model is UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # hash instead of sorting where every partition of a side turned out this small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and return the session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting falls back to a temporary folder, because a local
    session has no other machine that would need to see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that all executors share"
        )
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reelgauge-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")

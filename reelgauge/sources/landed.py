"""Tables kept current by batches, each a partition, and merged when read.

    <root>/<table>/job=<job>/number=<n>/   rows of batch n of a job

A batch belongs to a job, so jobs that share a root never meet.  Writing a batch replaces
its own partition only (dynamic partition overwrite), so one that runs again after a
failure neither doubles nor loses rows.  Batches apply in the order of the time at which
they were first written; one that runs again keeps its time.  A batch without rows writes
nothing.  The tables of a batch appear one after the other, in the order given.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgauge import schemas
from reelgauge.operators import upsert as U

TABLES: dict[str, tuple[T.StructType, U.UpsertRule]] = {
    "videos": (schemas.VIDEOS, U.VIDEO_RULE),
    "comments": (schemas.COMMENTS, U.COMMENT_RULE),
    "channels": (schemas.CHANNELS, U.CHANNEL_RULE),
}

#: Columns beside a table's own; the last two are the partition.
BATCH = "seq long, written timestamp, job string, number long"


def _rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All stored rows with the columns of their batch; none if nothing was ever written."""
    schema = T.StructType([*TABLES[name][0], *T.StructType.fromDDL(BATCH)])
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _of_batch(job: str, number: int) -> Column:
    return (F.col("job") == job) & (F.col("number") == number)


def commit_batch(root: str, number: int, tables: Mapping[str, DataFrame], job: str = "manual") -> None:
    """Store the rows of batch ``number`` of a job, each with its ``seq``, in place of an earlier run's."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", job):
        raise ValueError(f"not a name for a job: {job!r}")
    now = dt.datetime.now(dt.timezone.utc)
    for name, rows in tables.items():
        earlier = _rows(rows.sparkSession, root, name).filter(_of_batch(job, number))
        written = earlier.agg(F.min("written")).first()[0]
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name][0]]
        (
            rows.select(
                *columns,
                F.col("seq").cast("long").alias("seq"),
                F.lit(written or now).alias("written"),
                F.lit(job).alias("job"),
                F.lit(number).cast("long").alias("number"),
            )
            .write.partitionBy("job", "number")
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .parquet(f"{root}/{name}")
        )


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Current rows: all batches applied in order, folded in one aggregation.

    Rows of one key with one ``seq`` in one batch are ordered by their content, so
    which of them wins doesn't depend on tasks.
    """
    schema, rule = TABLES[name]
    content = F.xxhash64(*(F.col(c).cast("string") for c in schema.names)).alias("content")
    order = F.struct("written", "job", "number", "seq", content)
    return U.fold_batch(_rows(spark, root, name), rule, seq=order).select(*schema.names)


def read_ids(
    spark: SparkSession, root: str, name: str = "videos", without: tuple[str, int] | None = None
) -> DataFrame:
    """Keys stored so far; needs no merging and reads one column.

    ``without`` names a (job, number) whose rows don't count, for a batch that runs again.
    """
    rows = _rows(spark, root, name)
    if without is not None:
        rows = rows.filter(~_of_batch(*without))
    return rows.select(TABLES[name][1].key).distinct()

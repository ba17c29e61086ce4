"""Incremental ingestion of landed video records.

Both jobs are keyed by video id and ordered by arrival, so there is no watermark
and no state to grow: what is known lives in the stored partitions, one a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reelgauge.operators.joins import new_videos
from reelgauge.sources.landed import commit_batch, read_ids
from reelgauge.sources.records import parse_videos

LANDED = "seq long, payload string"


def read_landed(
    spark: SparkSession, folder: str, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of landed records: JSON lines with a running number and the response."""
    reader = spark.readStream.schema(LANDED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def _run(
    landed: DataFrame, root: str, job: str, write: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    return (
        landed.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/progress/{job}")
        .trigger(availableNow=True)
        .start()
    )


def upsert_batch(root: str, collected: str | None, job: str) -> Callable[[DataFrame, int], None]:
    """What ``upsert_stream`` does with a micro-batch."""
    def write(batch: DataFrame, number: int) -> None:
        commit_batch(root, number, {"videos": parse_videos(batch, collected=collected)}, job)

    return write


def new_video_batch(root: str, collected: str | None, job: str) -> Callable[[DataFrame, int], None]:
    """What ``new_video_stream`` does; a batch that runs again doesn't meet its own rows."""
    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_videos(batch, collected=collected)
        known = read_ids(batch.sparkSession, root, without=(job, number))
        commit_batch(root, number, {"videos": new_videos(parsed, known)}, job)

    return write


def upsert_stream(
    landed: DataFrame, root: str, collected: str | None = None, job: str = "upsert"
) -> StreamingQuery:
    """Apply every landed record; the last write of a video wins.

    Each micro-batch only stores its own rows, under the name of its job.  A batch that
    is run again after a failure takes the place of what it wrote before.
    """
    return _run(landed, root, job, upsert_batch(root, collected, job))


def new_video_stream(
    landed: DataFrame, root: str, collected: str | None = None, job: str = "new-videos"
) -> StreamingQuery:
    """Store only records of videos that no other batch has stored."""
    return _run(landed, root, job, new_video_batch(root, collected, job))

"""Checks that stand in for the constraints of the table definitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    """Primary-key values that occur more than once."""
    return (
        table.groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
    )


def null_counts(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column that must have none, one row per column, in one pass."""
    counted = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column", "nulls")


def orphans(
    child: DataFrame, foreign_key: str, parent: DataFrame, key: str, relation: str
) -> DataFrame:
    """Foreign-key values without a parent row, with the number of rows using them.

    The child is reduced to its distinct values first, so a value used by many
    rows meets the parent once.
    """
    used = (
        child.filter(F.col(foreign_key).isNotNull())
        .groupBy(F.col(foreign_key).alias("key"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    present = parent.select(F.col(key).alias("key"))
    missing = used.join(present, "key", "left_anti")
    return missing.select(F.lit(relation).alias("relation"), "key", "rows")


def all_orphans(channels: DataFrame, videos: DataFrame, comments: DataFrame) -> DataFrame:
    """The three relations: video to channel, comment to video, reply to parent."""
    parts = [
        orphans(videos, "channelId", channels, "channelId", "video-channel"),
        orphans(comments, "videoId", videos, "videoId", "comment-video"),
        orphans(comments, "parentCommentId", comments, "commentId", "reply-parent"),
    ]
    return reduce(DataFrame.unionByName, parts)

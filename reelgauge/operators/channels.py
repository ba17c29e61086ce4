"""Channel records: yearly update, profile and outcome counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.functions import clock
from reelgauge.operators.scaling import lookup_join


def has_id(c: Column) -> Column:
    """False for the blank filler rows of a channel list."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def yearly_update(
    channels: DataFrame, stats: DataFrame, year: int, collected_at: str
) -> DataFrame:
    """Add this year's figures to a channel list as three year-suffixed columns.

    Rows with an answer get the figures and the collection time; rows without
    one, blank ids included, stay in the list with 0, 0 and NULL.
    """
    fresh = stats.select(
        F.col("channelId").alias("id"),
        F.col("numberOfVideos").alias("_videos"),
        F.col("numberOfSubscribers").alias("_subscribers"),
        F.lit(True).alias("_found"),
    ).filter(has_id(F.col("id")))
    joined = lookup_join(channels, fresh, ["id"], "left")
    return joined.select(
        *channels.columns,
        F.coalesce("_videos", F.lit(0)).alias(f"videos{year}"),
        F.coalesce("_subscribers", F.lit(0)).alias(f"inscritos{year}"),
        F.when(F.col("_found"), F.lit(collected_at).cast("timestamp")).alias(
            f"dataColetada{year}"
        ),
    )


def update_outcome(updated: DataFrame, year: int) -> DataFrame:
    """Channels processed, updated and failed; blank rows are only processed."""
    stamped = F.col(f"dataColetada{year}").isNotNull()
    return updated.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(stamped).alias("updated"),
        F.count_if(~stamped & has_id(F.col("id"))).alias("failed"),
    )


def channel_profile(
    listed: DataFrame, details: DataFrame, day_collected: str
) -> DataFrame:
    """Channel rows whose size is the number of listed videos."""
    sizes = listed.groupBy("channelId").agg(F.count(F.lit(1)).alias("numberOfVideos"))
    joined = details.select("channelId", "channelName", "numberOfSubscribers").join(
        sizes, "channelId", "left"
    )
    return joined.select(
        "channelId",
        "channelName",
        F.lit(day_collected).cast("date").alias("dayCollected"),
        "numberOfSubscribers",
        F.coalesce("numberOfVideos", F.lit(0)).alias("numberOfVideos"),
    )


def transcript_outcome(videos: DataFrame) -> DataFrame:
    """Saved videos with and without transcript, per channel."""
    filled = F.coalesce(F.length("videoTranscript") > 0, F.lit(False))
    return videos.groupBy("channelId").agg(
        F.count(F.lit(1)).alias("saved"),
        F.count_if(filled).alias("with_transcript"),
        F.count_if(~filled).alias("without_transcript"),
    )


def dated_export(updated: DataFrame, year: int) -> DataFrame:
    """Collection times as the text the list file carries."""
    names = ["dataCollected", f"dataColetada{year}"]
    return updated.withColumns({c: clock.stamp(F.col(c)) for c in names})

"""Batch ingestion: landed responses of one collection run to the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgauge.operators.channels import channel_profile
from reelgauge.operators.filters import between, comments_enabled
from reelgauge.operators.joins import new_videos, video_details
from reelgauge.operators.picks import pick_transcript_language
from reelgauge.operators.scaling import materialise
from reelgauge.operators.upsert import patch_transcripts
from reelgauge.sources import records
from reelgauge.sources.landed import commit_batch, read_ids


def collect(
    spark: SparkSession,
    root: str,
    number: int,
    playlists: DataFrame,
    videos: DataFrame,
    threads: DataFrame,
    channels: DataFrame,
    transcripts: DataFrame,
    day: str,
    start: str | None = None,
    end: str | None = None,
) -> None:
    """Store the new videos of the listed playlists with their comments and channels.

    ``playlists``, ``videos`` and ``channels`` are response pages in ``payload``;
    ``threads`` has ``videoId`` and ``payload``; ``transcripts`` has rows of
    (videoId, language, seq, text).  Videos are stored last: they decide what is new, so a
    run that ends between its tables stores all of them when it runs again.
    """
    listed = between(records.parse_playlist(playlists), start, end).select("videoId")
    wanted = materialise(new_videos(listed.distinct(), read_ids(spark, root, without=("collect", number))))
    details = records.parse_videos(videos, collected=day)
    fetched = video_details(wanted, details)
    texts = pick_transcript_language(transcripts).select(
        "videoId",
        F.col("text").alias("videoTranscript"),
        F.col("language").alias("transcriptLanguage"),
    )
    stored = materialise(patch_transcripts(fetched, texts))
    open_videos = comments_enabled(stored).select("videoId")
    comments = records.flatten_threads(
        threads.join(open_videos, "videoId", "left_semi"), collected=day
    )
    profiles = channel_profile(details, records.parse_channels(channels), day)
    # repeated responses of a run are told apart by their content when the table is read
    commit_batch(
        root,
        number,
        {
            "comments": comments.withColumn("seq", F.lit(0)),
            "channels": profiles.withColumn("seq", F.lit(0)),
            "videos": stored.withColumn("seq", F.lit(0)),
        },
        "collect",
    )

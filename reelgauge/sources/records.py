"""Landed API responses (one JSON text per row) to table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge import schemas
from reelgauge.functions import clock

# Fixed value: kind of a search hit that is a video.
VIDEO_KIND = "youtube#video"


def _count(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def _day(collected: str | None) -> Column:
    return F.current_date() if collected is None else F.lit(collected).cast("date")


def _items(pages: DataFrame, schema, payload: str, *carry: str) -> DataFrame:
    parsed = pages.select(*carry, F.from_json(payload, schema).alias("_page"))
    return parsed.select(*carry, F.explode("_page.items").alias("item"))


def _pages_or_records(frame: DataFrame, page_schema, record_schema, payload: str, *carry: str) -> DataFrame:
    """One row per record of response pages; a payload may also be one bare record."""
    parsed = frame.select(*carry, F.from_json(payload, page_schema).alias("_page"))
    bare = F.struct(*(F.col(f"_page.{f.name}").alias(f.name) for f in record_schema))
    return parsed.select(*carry, F.explode(F.coalesce("_page.items", F.array(bare))).alias("_v"))


def parse_channels(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Channel id, name, subscribers and videos; absent counts are 0, absent name N/A."""
    items = _items(pages, schemas.API_CHANNEL_PAGE, payload)
    return items.select(
        F.col("item.id").alias("channelId"),
        F.coalesce("item.snippet.title", F.lit("N/A")).alias("channelName"),
        _count(F.col("item.statistics.subscriberCount")).alias("numberOfSubscribers"),
        _count(F.col("item.statistics.videoCount")).alias("numberOfVideos"),
    )


def parse_videos(
    records: DataFrame, payload: str = "payload", collected: str | None = None
) -> DataFrame:
    """Video rows plus ``commentsEnabled``; absent counts are 0.

    Payloads are response pages of several videos or single records.  Comments are
    enabled if the record has a comment count at all.  A record without an id is no
    video and gives no row; ``without_id`` lists the payloads that have such records.
    """
    carried = [c for c in records.columns if c != payload]
    parsed = _pages_or_records(records, schemas.API_VIDEO_PAGE, schemas.API_VIDEO, payload, *carried)
    parsed = parsed.filter(F.col("_v.id").isNotNull())
    return parsed.select(
        *carried,
        F.col("_v.id").alias("videoId"),
        F.col("_v.snippet.channelId").alias("channelId"),
        F.col("_v.snippet.title").alias("videoTitle"),
        F.lit(None).cast("string").alias("videoAudio"),
        F.lit(None).cast("string").alias("videoTranscript"),
        _count(F.col("_v.statistics.viewCount")).alias("viewCount"),
        _count(F.col("_v.statistics.likeCount")).alias("likeCount"),
        _count(F.col("_v.statistics.commentCount")).alias("commentCount"),
        clock.parse_timestamp(F.col("_v.snippet.publishedAt")).alias("publishedAt"),
        _day(collected).alias("collectedDate"),
        F.lit(None).cast("string").alias("transcriptLanguage"),
        F.col("_v.statistics.commentCount").isNotNull().alias("commentsEnabled"),
    )


def without_id(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows whose payload holds a record without an id, or can't be read: for an error table."""
    page = F.from_json(payload, schemas.API_VIDEO_PAGE)
    ids = F.coalesce(page["items"]["id"], F.array(page["id"]))
    return records.filter(F.coalesce(F.exists(ids, lambda i: i.isNull()), F.lit(True)))


def parse_playlist(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Video id and publication time of every playlist item."""
    items = _items(pages, schemas.API_PLAYLIST_PAGE, payload)
    return items.select(
        F.coalesce("item.contentDetails.videoId", "item.snippet.resourceId.videoId").alias(
            "videoId"
        ),
        clock.parse_timestamp(F.col("item.snippet.publishedAt")).alias("publishedAt"),
    )


def parse_search(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Ids of the search hits that are videos."""
    items = _items(pages, schemas.API_SEARCH_PAGE, payload)
    return items.filter(F.col("item.id.kind") == VIDEO_KIND).select(
        F.col("item.id.videoId").alias("videoId")
    )


def flatten_threads(
    threads: DataFrame,
    payload: str = "payload",
    video_id: str = "videoId",
    collected: str | None = None,
) -> DataFrame:
    """Comment rows from pages of threads or single ones: the top comment, then its replies.

    A comment without an id gives no row.
    """
    parsed = _pages_or_records(threads, schemas.API_THREAD_PAGE, schemas.API_THREAD, payload, video_id)
    parsed = parsed.withColumnRenamed("_v", "_t")
    top = F.col("_t.snippet.topLevelComment")
    replies = F.coalesce(
        F.col("_t.replies.comments"), F.array().cast(_comment_array_type())
    )
    entries = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("parent"), top.alias("c"))),
        F.transform(
            replies, lambda r: F.struct(top["id"].alias("parent"), r.alias("c"))
        ),
    )
    flat = parsed.select(video_id, F.explode(entries).alias("e")).filter(F.col("e.c.id").isNotNull())
    return flat.select(
        F.col("e.c.id").alias("commentId"),
        F.col(video_id).alias("videoId"),
        F.col("e.parent").alias("parentCommentId"),
        F.col("e.c.snippet.authorChannelId.value").alias("userId"),
        F.col("e.c.snippet.authorDisplayName").alias("userName"),
        F.col("e.c.snippet.textDisplay").alias("content"),
        F.col("e.c.snippet.likeCount").alias("likeCount"),
        clock.parse_timestamp(F.col("e.c.snippet.publishedAt")).alias("publishedAt"),
        _day(collected).alias("collectedDate"),
    )


def _comment_array_type():
    return schemas.API_THREAD["replies"].dataType["comments"].dataType


def parse_snippets(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``snippets``: the ordered transcript pieces of a landed transcript."""
    return records.withColumn("snippets", F.from_json(payload, schemas.SNIPPETS)).drop(
        payload
    )

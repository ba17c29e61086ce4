"""Lookups, anti-joins and joins between the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.functions import text as X
from reelgauge.operators.scaling import BROADCAST_BYTES, hot_key_join, lookup_join, unnest


def channel_names(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """Add ``channelName``, the channel id where the channel is not listed."""
    names = channels.select("channelId", "channelName")
    joined = lookup_join(rows, names, ["channelId"], "left")
    return joined.withColumn("channelName", F.coalesce("channelName", "channelId"))


def new_videos(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed rows whose video is not stored; repeats in the list are kept."""
    known = stored.select("videoId").distinct()
    return hot_key_join(listed, known, ["videoId"], "left_anti")


def stored_videos(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed rows whose video is stored already."""
    known = stored.select("videoId").distinct()
    return hot_key_join(listed, known, ["videoId"], "left_semi")


def known_ids(stored: DataFrame, added: DataFrame) -> DataFrame:
    return stored.select("videoId").unionByName(added.select("videoId")).distinct()


def video_details(ids: DataFrame, details: DataFrame) -> DataFrame:
    """Details of the listed ids; ids without an answer vanish."""
    return hot_key_join(ids, details, ["videoId"], "inner")


def videos_with_transcript(videos: DataFrame, available: DataFrame) -> DataFrame:
    """Videos for which a transcript is known to exist."""
    return videos.join(available.select("videoId").distinct(), "videoId", "left_semi")


def comment_threads(comments: DataFrame) -> DataFrame:
    """Replies with the author and text of their parent; NULL if it is missing."""
    replies = comments.filter(F.col("parentCommentId").isNotNull())
    parents = comments.select(
        F.col("commentId").alias("parentCommentId"),
        F.col("userId").alias("parentUserId"),
        F.col("content").alias("parentContent"),
    )
    return hot_key_join(replies, parents, ["parentCommentId"], "left")


def comments_per_video(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Comments, replies and likes of every video, zero for videos without any.

    Comments are summed before the join, which leaves one row per video.
    """
    totals = comments.groupBy("videoId").agg(
        F.count(F.lit(1)).alias("comments"),
        F.count("parentCommentId").alias("replies"),
        F.sum("likeCount").alias("likes"),
    )
    joined = videos.select("videoId").join(totals, "videoId", "left")
    return joined.fillna(0, ["comments", "replies", "likes"])


# --- lemmas -------------------------------------------------------------------

def lemma_counts(term_counts: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Occurrences per document and lemma; a term without an entry is its own lemma.

    ``term_counts`` has one row per document and term, so a frequent word costs
    one row per document; ``lemmas`` has columns ``term`` and ``lemma``.
    """
    # words are short: bytes alone say whether the dictionary can travel in place of all counts
    joined = lookup_join(term_counts, lemmas, ["term"], "left", max_rows=BROADCAST_BYTES)
    return (
        joined.withColumn("lemma", F.coalesce("lemma", "term"))
        .groupBy("videoId", "lemma")
        .agg(F.sum("n").alias("n"))
    )


def replace_by_lemmas(rows: DataFrame, lemmas: DataFrame, column: str = "tokens") -> DataFrame:
    """Replace each token of an array column by its lemma, keeping the order.

    Arrays are known by their content, so rows with repeated or null ids keep their own
    tokens and equal arrays are put together once.  A null array becomes an empty one
    and null elements are left out.
    ``lemmas`` has one row per ``term``; a null lemma leaves the term.
    """
    # equal ids mean equal arrays: 128 bits of a form that keeps elements and nulls apart
    keyed = rows.withColumn("_array", F.md5(F.to_json(F.col(column))))
    exploded = unnest(keyed.select("_array", column), F.col(column), "term", "_pos").drop(column)
    found = lookup_join(exploded, lemmas, ["term"], "left")
    # a set, as equal arrays bring the same places; it combines before the exchange
    rebuilt = found.groupBy("_array").agg(
        F.sort_array(
            F.collect_set(F.struct("_pos", F.coalesce("lemma", "term").alias("lemma")))
        ).alias("_lemmas")
    )
    empty = F.array().cast("array<string>")
    return (
        keyed.drop(column)
        .join(rebuilt, "_array", "left")
        .withColumn(column, F.coalesce(F.col("_lemmas.lemma"), empty))
        .drop("_lemmas", "_array")
    )


def explode_stop_filtered(videos: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Tokens per video and language without the words of a stopword *table*.

    ``stopwords`` has columns ``lang`` and ``word``.
    """
    texts = videos.select(
        "videoId",
        F.col("transcriptLanguage").alias("lang"),
        X.tokenize(F.col("videoTranscript")).alias("_tokens"),
    )
    tokens = unnest(texts, F.col("_tokens"), "word", "pos").drop("_tokens")
    return lookup_join(tokens, stopwords, ["lang", "word"], "left_anti")

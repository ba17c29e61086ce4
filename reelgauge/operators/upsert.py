"""Insert-or-update and update-by-key as joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.functions import status
from reelgauge.operators.scaling import BROADCAST_ROWS, fits, lookup_join


@dataclass(frozen=True)
class UpsertRule:
    """What happens to each column when the key exists already.

    ``overwrite`` takes the new value, ``fill`` takes it unless it is NULL, and
    ``keep`` holds on to the stored one.
    """

    key: str
    overwrite: tuple[str, ...]
    fill: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [self.key, *self.overwrite, *self.fill, *self.keep]


VIDEO_RULE = UpsertRule(
    "videoId",
    overwrite=("videoTitle", "viewCount", "likeCount", "commentCount", "collectedDate"),
    fill=("videoTranscript", "transcriptLanguage"),
    keep=("channelId", "videoAudio", "publishedAt"),
)
COMMENT_RULE = UpsertRule(
    "commentId",
    overwrite=("content", "likeCount", "collectedDate"),
    keep=("videoId", "parentCommentId", "userId", "userName", "publishedAt"),
)
CHANNEL_RULE = UpsertRule(
    "channelId",
    overwrite=("channelName", "dayCollected", "numberOfSubscribers", "numberOfVideos"),
)


def fold_batch(batch: DataFrame, rule: UpsertRule, seq: str | Column = "seq") -> DataFrame:
    """One row per key, equal to applying the batch row by row in order of ``seq``.

    Senders fold their own rows first, so a key repeated many times is no burden.
    """
    order = F.col(seq) if isinstance(seq, str) else seq
    rows = batch.select(*rule.columns, order.alias("_seq"))
    parts = [F.max_by(F.struct(*rule.overwrite), F.col("_seq")).alias("_last")]
    if rule.keep:
        parts.append(F.min_by(F.struct(*rule.keep), F.col("_seq")).alias("_first"))
    parts += [
        F.expr(f"max_by({c}, _seq) FILTER (WHERE {c} IS NOT NULL)").alias(c)
        for c in rule.fill
    ]
    folded = rows.groupBy(rule.key).agg(*parts)
    return folded.select(
        rule.key,
        *[F.col(f"_last.{c}").alias(c) for c in rule.overwrite],
        *rule.fill,
        *[F.col(f"_first.{c}").alias(c) for c in rule.keep],
    )


def apply_folded(
    target: DataFrame,
    folded: DataFrame,
    rule: UpsertRule,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Merge a folded batch into the target.

    A batch of checked small size is broadcast and the target is not moved at
    all.  A larger one meets it in a full outer join; both sides have unique keys.
    """
    key = rule.key
    new = folded.select(
        key,
        *[F.col(c).alias(f"_new_{c}") for c in rule.columns if c != key],
        F.lit(True).alias("_new"),
    )
    old = target.select(*rule.columns, F.lit(True).alias("_old"))

    def value(c: str) -> Column:
        fresh, stored = F.col(f"_new_{c}"), F.col(c)
        if c in rule.overwrite:
            return F.when(F.col("_new"), fresh).otherwise(stored)
        if c in rule.fill:
            return F.coalesce(fresh, stored)
        return F.when(F.col("_old"), stored).otherwise(fresh)

    def merged(joined: DataFrame) -> DataFrame:
        chosen = {c: value(c).alias(c) for c in rule.columns if c != key}
        chosen[key] = F.col(key)
        return joined.select(*[chosen[c] for c in target.columns])

    if not fits(folded, max_rows):
        return merged(old.join(new, key, "full_outer"))
    updated = merged(old.join(F.broadcast(new), key, "left"))
    # at most one target row per batch key, so this is as small as the batch
    matched = target.select(key).join(F.broadcast(folded.select(key)), key, "left_semi")
    inserted = folded.join(F.broadcast(matched), key, "left_anti")
    return updated.unionByName(inserted.select(*target.columns))


def upsert(
    target: DataFrame,
    batch: DataFrame,
    rule: UpsertRule,
    seq: str | Column = "seq",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Insert new keys and update stored ones; ``seq`` orders repeats of a key."""
    return apply_folded(target, fold_batch(batch, rule, seq), rule, max_rows)


def upsert_videos(target: DataFrame, batch: DataFrame, **options) -> DataFrame:
    return upsert(target, batch, VIDEO_RULE, **options)


def upsert_comments(target: DataFrame, batch: DataFrame, **options) -> DataFrame:
    return upsert(target, batch, COMMENT_RULE, **options)


def upsert_channels(target: DataFrame, batch: DataFrame, **options) -> DataFrame:
    return upsert(target, batch, CHANNEL_RULE, **options)


# --- updates without insertion --------------------------------------------------

def patch(target: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Set the patch's columns on the rows it names, NULL included; insert nothing.

    ``patches`` has one row per key.
    """
    columns = [c for c in patches.columns if c != key]
    renamed = patches.select(
        key,
        *[F.col(c).alias(f"_new_{c}") for c in columns],
        F.lit(True).alias("_hit"),
    )
    joined = lookup_join(target, renamed, [key], "left")
    changed = {
        c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in target.columns])


def patch_transcripts(videos: DataFrame, patches: DataFrame) -> DataFrame:
    """Set transcript and language by video id."""
    return patch(
        videos, patches.select("videoId", "videoTranscript", "transcriptLanguage"), "videoId"
    )


def patch_audio_path(videos: DataFrame, paths: DataFrame) -> DataFrame:
    return patch(videos, paths.select("videoId", "videoAudio"), "videoId")


def transcript_patches(results: DataFrame) -> DataFrame:
    """Patches from fetch results of (videoId, ok, text, language).

    Fetched transcripts are stored.  Of the failures only the lasting ones are,
    as a status in place of the transcript; the others stay open for a retry.
    """
    text, ok = F.col("text"), F.col("ok")
    lasting = ~ok & F.coalesce(status.is_recorded_status(text), F.lit(False))
    language = F.when(ok, F.col("language")).otherwise(
        F.coalesce("language", F.lit(status.LANGUAGE_UNAVAILABLE))
    )
    return results.filter(ok | lasting).select(
        "videoId",
        text.alias("videoTranscript"),
        language.alias("transcriptLanguage"),
    )


def add_missing_column(df: DataFrame, name: str, data_type: str = "string") -> DataFrame:
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(None).cast(data_type))

"""Projections, type coercion and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgauge.functions import clock, status
from reelgauge.functions import text as X
from reelgauge.schemas import ANALYSIS_COLUMNS, METRICS


# --- columns ------------------------------------------------------------------

def analysis_columns(videos: DataFrame) -> DataFrame:
    return videos.select(*ANALYSIS_COLUMNS)


def ensure_columns(df: DataFrame, schema: T.StructType, only: bool = True) -> DataFrame:
    """The schema's columns in its order, NULL where the input lacks one.

    ``only=False`` keeps further input columns behind them.
    """
    have = set(df.columns)
    wanted = [
        F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    names = set(schema.fieldNames())
    rest = [] if only else [F.col(c) for c in df.columns if c not in names]
    return df.select(*wanted, *rest)


def resolve_columns(df: DataFrame, candidates: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename columns to the required names.

    A required name that is present stays.  Otherwise its candidates are tried in
    order, each as a case-insensitive part of a column name; the first hit is
    renamed.  No hit is an error: values are never made up.
    """
    out = df
    for required, patterns in candidates.items():
        if required in out.columns:
            continue
        for pattern in patterns:
            hits = [c for c in out.columns if pattern.lower() in c.lower()]
            hits = [c for c in hits if c not in candidates]
            if hits:
                out = out.withColumnRenamed(hits[0], required)
                break
        else:
            raise ValueError(f"no column for {required!r} among {df.columns}")
    return out


# --- types --------------------------------------------------------------------

def coerce_types(
    df: DataFrame,
    times: Sequence[str] = ("publishedAt",),
    metrics: Sequence[str] = METRICS,
    fill: int | None = None,
) -> DataFrame:
    """Parse times and metrics from text; bad cells are NULL, or ``fill`` for metrics.

    A column that has its type already is left alone, so filters on it reach the scan.
    """
    kinds = dict(df.dtypes)
    parsed = {t: clock.parse_timestamp(F.col(t).cast("string")) for t in times if kinds[t] != "timestamp"}
    for m in metrics:
        cell = F.col(m).cast("string")
        whole, decimal = cell.try_cast("long"), cell.try_cast("double").try_cast("long")
        number = F.col(m) if kinds[m] == "bigint" else F.coalesce(whole, decimal)
        parsed[m] = number if fill is None else F.coalesce(number, F.lit(fill).cast("long"))
    return df.withColumns(parsed)


# --- rows ---------------------------------------------------------------------

def with_transcript_status(videos: DataFrame) -> DataFrame:
    """Move a status that was stored as the transcript to ``transcriptStatus``."""
    text = F.col("videoTranscript")
    flagged = F.coalesce(status.is_recorded_status(text), F.lit(False))
    return videos.withColumns(
        {
            "transcriptStatus": F.when(flagged, text),
            "videoTranscript": F.when(~flagged, text),
        }
    )


def valid_videos(
    videos: DataFrame,
    required: Sequence[str] = ("videoTranscript", "channelId", "publishedAt"),
    metrics: Sequence[str] = METRICS,
    keep_status_rows: bool = False,
) -> DataFrame:
    """Rows fit for analysis: required and metric columns set, transcript not blank.

    Statuses stored as transcripts are left out unless ``keep_status_rows``.
    """
    text = F.col("videoTranscript")
    rows = videos.dropna(subset=[*required, *metrics]).filter(~X.is_blank(text))
    if keep_status_rows:
        return rows
    return rows.filter(~status.is_recorded_status(text))


#: Partition column of tables stored by month: the first day of a row's month.
MONTH = "publishMonth"


def in_months(
    df: DataFrame, ranges: Sequence[tuple[Column | None, Column | None]], column: str = "publishedAt"
) -> DataFrame:
    """Leave out months that no (start, end) of ``ranges`` touches, where the table is stored by month.

    It follows from the time filter that comes with it, so rows are the same; what it
    adds is that the scan lists no other partitions.  Other tables are left alone.
    """
    if column != "publishedAt" or MONTH not in df.columns:
        return df
    month, touched = F.col(MONTH), F.lit(False)
    for start, end in ranges:
        low = F.lit(True) if start is None else month >= F.trunc(start, "month")
        high = F.lit(True) if end is None else month <= F.trunc(end, "month")
        touched = touched | (low & high)
    return df.filter(touched)


def between(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    closed: str = "both",
    column: str = "publishedAt",
) -> DataFrame:
    """Rows inside optional bounds; ``closed="left"`` leaves the end out."""
    at = F.col(column)
    low, high = (None if t is None else F.lit(t).cast("timestamp") for t in (start, end))
    if low is not None:
        df = df.filter(at >= low)
    if high is not None:
        df = df.filter(at < high if closed == "left" else at <= high)
    return df if low is None and high is None else in_months(df, [(low, high)], column)


def channel(videos: DataFrame, channel_id: str) -> DataFrame:
    return videos.filter(F.col("channelId") == channel_id)


def has_transcript(videos: DataFrame) -> DataFrame:
    return videos.filter(F.length("videoTranscript") > 0)


def transcript_backlog(
    videos: DataFrame,
    start_day: str | None = None,
    end_day: str | None = None,
    sequence: str = "ingest_seq",
) -> DataFrame:
    """Videos without transcript, newest insertion first; day bounds are inclusive."""
    waiting = videos.filter(F.col("videoTranscript").isNull())
    if start_day is not None:
        waiting = between(waiting, start=f"{start_day} 00:00:00")
    if end_day is not None:
        waiting = between(waiting, end=f"{end_day} 23:59:59")
    return waiting.orderBy(F.col(sequence).desc())


# Fixed value: address of a video's page.
WATCH_URL = "https://www.youtube.com/watch?v="


def audio_backlog(videos: DataFrame, folder: str = "audio/audio_files") -> DataFrame:
    """Videos without an audio path, with the page to fetch and the path to fill."""
    path = F.col("videoAudio")
    return videos.filter(path.isNull() | (path == "")).select(
        "videoId",
        F.concat(F.lit(WATCH_URL), F.col("videoId")).alias("videoUrl"),
        F.concat(F.lit(f"{folder}/"), F.col("videoId"), F.lit(".mp3")).alias("audioPath"),
    )


def comments_enabled(videos: DataFrame) -> DataFrame:
    return videos.filter("commentsEnabled")

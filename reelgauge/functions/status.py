"""Status rules for transcripts that could not be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The status texts and language marks stored with a video.
PRIVATE = "VIDEO_UNAVAILABLE: Video is private"
DELETED = "VIDEO_UNAVAILABLE: Video has been deleted"
REMOVED = "VIDEO_UNAVAILABLE: Video has been removed"
UNAVAILABLE = "VIDEO_UNAVAILABLE: Video is unavailable"
AGE_RESTRICTED = "VIDEO_UNAVAILABLE: Video is age-restricted"
COPYRIGHT = "VIDEO_UNAVAILABLE: Video has copyright issues"
RECORDED_PREFIXES = ("VIDEO_UNAVAILABLE", "TRANSCRIPT_UNAVAILABLE")
LANGUAGE_UNAVAILABLE = "unavailable"
LANGUAGE_ERROR = "error"


def _about_age(text: Column) -> Column:
    return text.contains("age") & (text.contains("restrict") | text.contains("content"))


def _result(text: Column | str, language: str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(text.alias("status"), F.lit(language).alias("language"))


# Error kinds that mean a reachable video without a transcript, and their result.
WITHOUT_TRANSCRIPT_KINDS = ("NoTranscriptFound", "TranscriptsDisabled")
NO_TRANSCRIPT = "TRANSCRIPT_UNAVAILABLE: No transcript available for this video"
LANGUAGE_NOT_AVAILABLE = "not_available"


def without_transcript(kind: Column) -> Column:
    """True for the error kinds *none found* and *disabled*."""
    return F.coalesce(kind.isin(*WITHOUT_TRANSCRIPT_KINDS), F.lit(False))


def precheck_status(message: Column, kind: Column | None = None) -> Column:
    """Status and language when listing the transcripts already fails; ``kind`` names the error."""
    text = F.lower(message)
    kind = F.lit(None).cast("string") if kind is None else kind
    return (
        F.when(without_transcript(kind), _result(NO_TRANSCRIPT, LANGUAGE_NOT_AVAILABLE))
        .when(text.contains("private"), _result(PRIVATE, LANGUAGE_UNAVAILABLE))
        .when(text.contains("deleted"), _result(DELETED, LANGUAGE_UNAVAILABLE))
        .when(text.contains("removed"), _result(REMOVED, LANGUAGE_UNAVAILABLE))
        .when(text.contains("unavailable"), _result(UNAVAILABLE, LANGUAGE_UNAVAILABLE))
        .when(_about_age(text), _result(AGE_RESTRICTED, LANGUAGE_UNAVAILABLE))
        .otherwise(
            _result(F.concat(F.lit("VIDEO_UNAVAILABLE: "), message), LANGUAGE_UNAVAILABLE)
        )
    )


def fetch_status(message: Column) -> Column:
    """Status and language when fetching the chosen transcript fails."""
    text = F.lower(message)
    gone = text.contains("unavailable") | text.contains("no longer available")
    return (
        F.when(text.contains("private"), _result(PRIVATE, LANGUAGE_UNAVAILABLE))
        .when(text.contains("deleted"), _result(DELETED, LANGUAGE_UNAVAILABLE))
        .when(gone, _result(UNAVAILABLE, LANGUAGE_UNAVAILABLE))
        .when(_about_age(text), _result(AGE_RESTRICTED, LANGUAGE_UNAVAILABLE))
        .when(text.contains("copyright"), _result(COPYRIGHT, LANGUAGE_UNAVAILABLE))
        .otherwise(_result(F.concat(F.lit("ERROR: "), message), LANGUAGE_ERROR))
    )


def may_have_transcript(message: Column, kind: Column | None = None) -> Column:
    """False if the video is out of reach or its error ``kind`` says it has no transcript."""
    text = F.lower(message)
    kind = F.lit(None).cast("string") if kind is None else kind
    unreachable = (
        text.contains("video is no longer available")
        | text.contains("video unavailable")
        | text.contains("age-restricted")
        | text.contains("age restricted")
    )
    return ~unreachable & ~without_transcript(kind)


def is_recorded_status(text: Column) -> Column:
    """A status that is stored in place of the transcript."""
    return text.startswith(RECORDED_PREFIXES[0]) | text.startswith(RECORDED_PREFIXES[1])

"""One row per group by preference or by largest value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.functions.text import excerpt

#: Preferred transcript languages and subtitle file types.
TRANSCRIPT_LANGUAGES = ("pt", "pt-BR", "en")
SUBTITLE_TYPES = ("vtt", "srt", "srv3", "srv2", "srv1")


def _preference(c: Column, preferred: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, preferred)), c)


def pick_preferred(
    rows: DataFrame,
    by: Sequence[str],
    choice: str,
    preferred: Sequence[str],
    tie: str,
    keep: Sequence[str],
) -> DataFrame:
    """Per group the row whose ``choice`` comes first in ``preferred``.

    Rows with another choice never win; equal choices fall to the smallest
    ``tie``.  It is a minimum, so senders reduce each group to one row.
    """
    ranked = rows.withColumn("_rank", _preference(F.col(choice), preferred)).filter(
        F.col("_rank") > 0
    )
    best = F.min_by(F.struct(choice, *keep), F.struct("_rank", tie)).alias("_best")
    picked = ranked.groupBy(*by).agg(best)
    return picked.select(*by, *[F.col(f"_best.{c}").alias(c) for c in (choice, *keep)])


def pick_transcript_language(
    transcripts: DataFrame, preferred: Sequence[str] = TRANSCRIPT_LANGUAGES
) -> DataFrame:
    """Best transcript of each video from rows of (videoId, language, seq, text)."""
    return pick_preferred(
        transcripts, ["videoId"], "language", preferred, "seq", ["seq", "text"]
    )


def pick_subtitle_file(
    files: DataFrame, lang: str, preferred: Sequence[str] = SUBTITLE_TYPES
) -> DataFrame:
    """Best subtitle file of each video from names like ``<video>.<lang>.<type>``."""
    parts = F.regexp_extract
    pattern = r"^(.*)\.([^.]+)\.([^.]+)$"
    name = F.col("file")
    parsed = files.select(
        "file",
        parts(name, pattern, 1).alias("videoId"),
        parts(name, pattern, 2).alias("lang"),
        parts(name, pattern, 3).alias("ext"),
    ).filter(F.col("lang") == lang)
    return pick_preferred(parsed, ["videoId"], "ext", preferred, "file", ["file"])


def argmax_per_group(
    rows: DataFrame, by: Sequence[str], value: str, key: str, text: str, length: int = 200
) -> DataFrame:
    """The row with the largest ``value`` per group (smallest ``key`` on ties).

    The text is cut to an excerpt before it travels.
    """
    best = F.min_by(
        F.struct(key, value, excerpt(F.col(text), length).alias("example")),
        F.struct((-F.col(value)).alias("_v"), F.col(key).alias("_k")),
    ).alias("_best")
    picked = rows.groupBy(*by).agg(best)
    return picked.select(*by, *[f"_best.{c}" for c in (key, value, "example")])

"""Cleaning jobs: stored videos to the file the analyses read."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.functions import text as X
from reelgauge.operators.filters import analysis_columns, between, coerce_types
from reelgauge.operators.joins import replace_by_lemmas
from reelgauge.sources.files import write_csv

Lemmatiser = Callable[[Column], Column]


def content_lemmas(tokens: Column, stopwords: Iterable[str]) -> Column:
    """Lower-cased lemmas that are long enough and no stopwords."""
    stop = list(stopwords)
    lowered = F.transform(tokens, F.lower)
    return F.filter(lowered, lambda t: X.is_content_lemma(t, stop))


def _lemmatise(
    rows: DataFrame, lemmas: DataFrame | None, lemmatiser: Lemmatiser | None
) -> DataFrame:
    """Lemmas of the ``tokens`` column: a Column function, a dictionary, or as they are.

    ``lemmatiser`` maps the token array to a lemma array and may wrap a pandas UDF
    that loads a language model once per worker.
    """
    if lemmatiser is not None:
        return rows.withColumn("tokens", lemmatiser(F.col("tokens")))
    if lemmas is not None:
        return replace_by_lemmas(rows, lemmas)
    return rows


def clean_transcripts(
    videos: DataFrame,
    stopwords: Iterable[str],
    lemmas: DataFrame | None = None,
    lemmatiser: Lemmatiser | None = None,
) -> DataFrame:
    """Full cleaning: ``cleanTranscript`` of content lemmas replaces the transcript.

    Metrics that are missing or no number become 0.
    """
    typed = coerce_types(videos, fill=0)
    pieces = F.filter(
        X.word_pieces(X.clean_basic(F.col("videoTranscript"))), X.is_alphabetic
    )
    tokens = _lemmatise(
        typed.withColumn("tokens", pieces).drop("videoTranscript"), lemmas, lemmatiser
    )
    kept = F.array_join(content_lemmas(F.col("tokens"), stopwords), " ")
    return tokens.withColumn("cleanTranscript", kept).drop("tokens")


def export_transcripts(
    videos: DataFrame,
    stopwords: Iterable[str],
    lemmas: DataFrame | None = None,
    lemmatiser: Lemmatiser | None = None,
) -> DataFrame:
    """Light cleaning in place: alphabetic non-stopwords, case kept."""
    stop = list(stopwords)
    pieces = F.filter(
        X.word_pieces(X.clean_export(F.col("videoTranscript"))),
        lambda t: X.is_alphabetic(t) & ~F.lower(t).isin(stop),
    )
    tokens = _lemmatise(videos.withColumn("tokens", pieces), lemmas, lemmatiser)
    return tokens.withColumn(
        "videoTranscript", F.array_join("tokens", " ")
    ).drop("tokens")


def export_window(
    videos: DataFrame,
    path: str,
    stopwords: Iterable[str],
    start: str = "2022-10-31 00:00:00",
    end: str = "2023-04-01 00:00:00",
) -> None:
    """Write the cleaned videos of a half-open window to the analysis file."""
    window = between(analysis_columns(videos), start, end, closed="left")
    write_csv(export_transcripts(window, stopwords), path)

"""The full analysis of the periods, for all channels and each channel."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.functions import text as X
from reelgauge.operators import filters as FI
from reelgauge.operators import topics as T
from reelgauge.operators.clusters import cluster_engagement
from reelgauge.operators.engagement import (
    ALL_CHANNELS,
    PERIODS,
    Period,
    assign_periods,
    with_tiers,
    tier_sizes,
)
from reelgauge.operators.joins import channel_names
from reelgauge.operators.ngrams import top_bigrams
from reelgauge.operators.scaling import materialise
from reelgauge.schemas import METRICS
from reelgauge.sources.files import write_results


def analysis_rows(
    videos: DataFrame,
    periods: Sequence[Period] = PERIODS,
    channel_id: str | None = None,
) -> DataFrame:
    """Typed and valid videos inside the periods, of one channel if given."""
    rows = videos if channel_id is None else FI.channel(videos, channel_id)
    return assign_periods(FI.valid_videos(FI.coerce_types(rows)), periods)


#: Tables of a report.
PARTS = ("tiers", "bigrams", "topics", "clusters")


def tokenised_rows(
    rows: DataFrame, stopwords: Sequence[str], order: str | None = None, strict: bool = False
) -> DataFrame:
    """What all parts of a report read: ids, metrics, text, its tokens and its place in the corpus.

    ``strict`` deletes digits and square brackets before stopwords are looked up.
    """
    text = F.col("videoTranscript")
    clean = X.remove_stopwords_strict(text, stopwords) if strict else text
    places = [] if order is None else [F.col(order).alias("order_key")]
    return rows.select(
        "period", "channelId", "videoId", *METRICS, *places, text, X.content_tokens(clean, stopwords).alias("tokens")
    )


def period_report(
    videos: DataFrame,
    stopwords: Iterable[str],
    periods: Sequence[Period] = PERIODS,
    channel_id: str | None = None,
    names: DataFrame | None = None,
    examples: bool = True,
    ties: str = "alphabetical",
    order: str | None = None,
    strict: bool = False,
    parts: Sequence[str] = PARTS,
) -> dict[str, DataFrame]:
    """Tables of a report, keyed by ``tiers``, ``bigrams``, ``topics``, ``clusters``.

    All channels and every single channel are analysed side by side; with
    ``channel_id`` only that channel is, clusters included.  ``names`` replaces
    channel ids by names and keeps the id as ``entityId``.  Videos are scanned and
    tokenised once, into a stored table that every part reads its own columns of.
    ``ties="first_seen"`` takes the corpus order from the column ``order``; ``strict``
    is the strict cleaner.  ``parts`` names the tables wanted.
    """
    if ties == "first_seen" and order is None:
        raise ValueError("ties by first appearance need a column that orders the corpus")
    if unknown := set(parts) - set(PARTS):
        raise ValueError(f"not parts of a report: {sorted(unknown)}")
    stop = list(stopwords)
    source = analysis_rows(videos, periods, channel_id)
    stored = tokenised_rows(source, stop, order, strict)
    # only topics show texts
    rows = materialise(stored if "topics" in parts else stored.drop("videoTranscript"))
    tables: dict[str, DataFrame] = {}
    if "tiers" in parts:
        tables["tiers"] = tier_sizes(with_tiers(rows.select("period", "channelId", "viewCount")))
    if "bigrams" in parts:
        tables["bigrams"] = top_bigrams(rows.drop("videoTranscript"), stop, ties=ties)
    if "topics" in parts:
        tokens = rows.select("period", "channelId", "videoId", "tokens")
        model = T.fit_topics(rows, stop, tokenised=tokens)
        tables["topics"] = T.topic_engagement(model, rows, examples)
    if "clusters" in parts:
        tables["clusters"] = cluster_engagement(rows.drop("videoTranscript", "tokens")).select(
            "period", F.col("channelId").alias("entity"), *METRICS, "cluster"
        )
    if channel_id is not None:
        single = F.col("entity") != ALL_CHANNELS
        tables = {name: table.filter(single) for name, table in tables.items()}
    if names is not None:
        tables = {name: _named(table, names) for name, table in tables.items()}
    return tables


def _named(table: DataFrame, names: DataFrame) -> DataFrame:
    keyed = table.withColumnRenamed("entity", "channelId")
    named = channel_names(keyed, names).withColumn("entity", F.col("channelName"))
    return named.select(*table.columns, F.col("channelId").alias("entityId"))


#: Folder columns of each written table.
FOLDERS = {
    "tiers": ["period"],
    "bigrams": ["period", "entity", "tier"],
    "topics": ["period", "entity"],
    "clusters": ["period", "entity"],
}


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One tab-separated result set per table."""
    for name, table in tables.items():
        write_results(table, f"{path}/{name}", FOLDERS[name])

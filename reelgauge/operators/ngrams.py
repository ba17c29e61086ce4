"""Term and bigram frequencies and the top bigrams of each tier."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgauge.functions import text as X
from reelgauge.operators.engagement import with_tiers
from reelgauge.operators.scaling import unnest

TOP_BIGRAMS = 15


def with_tokens(
    videos: DataFrame,
    stopwords: Iterable[str],
    column: str = "videoTranscript",
) -> DataFrame:
    """Replace the transcript by its ``tokens`` after stopword removal."""
    tokens = X.content_tokens(F.col(column), stopwords)
    return videos.withColumn("tokens", tokens).drop(column)


def doc_term_counts(tokenised: DataFrame, by: Sequence[str] = ("videoId",)) -> DataFrame:
    """Occurrences of every term per document."""
    return (
        unnest(tokenised.select(*by, "tokens"), F.col("tokens"), "term")
        .groupBy(*by, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bigram_counts(tokenised: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bigram frequency per group; adjacency closes over removed words."""
    return (
        unnest(tokenised.select(*by, "tokens"), X.bigrams(F.col("tokens")), "bigram")
        .groupBy(*by, "bigram")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def raw_bigram_counts(
    videos: DataFrame,
    by: Sequence[str],
    stopwords: Iterable[str],
    column: str = "videoTranscript",
) -> DataFrame:
    """Frequency of pairs adjacent in the raw text that contain no stopword.

    A pair counted here also gives its text two filtered tokens, so a group
    without any filtered bigram has none of these either: as a second attempt for
    such groups it yields nothing, and as a frequency of its own it is useful.
    """
    pairs = X.bigrams_without_stopwords(F.col("_tokens"), stopwords)
    tokenised = videos.select(*by, X.tokenize(F.col(column)).alias("_tokens"))
    return (
        unnest(tokenised, pairs, "bigram")
        .groupBy(*by, "bigram")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def top_per_group(
    counts: DataFrame,
    by: Sequence[str],
    n: int = TOP_BIGRAMS,
    order: Sequence | None = None,
) -> DataFrame:
    """The ``n`` most frequent rows of each group, with their ``rank``.

    Spark trims every partition to ``n`` rows per group before the exchange, so a
    group of any size costs its task only ``n`` rows per sender.
    """
    order = order or [F.col("frequency").desc(), F.col("bigram")]
    ranking = Window.partitionBy(*by).orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(ranking)).filter(
        F.col("rank") <= n
    )


def _place(rows: DataFrame) -> Column:
    """``order_key`` and ``_pos`` as one value with the same order, a missing key first.

    Whole numbers become one decimal, which a hash aggregate can keep; the smallest
    struct would need all pairs sorted before they are combined.
    """
    if dict(rows.dtypes)["order_key"] not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct("order_key", "_pos")
    key = F.coalesce(F.col("order_key").cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    return (key * F.lit(str(1 << 31)).cast("decimal(10,0)") + F.col("_pos")).cast("decimal(38,0)")


def top_bigrams(
    in_period: DataFrame,
    stopwords: Iterable[str],
    n: int = TOP_BIGRAMS,
    ties: str = "alphabetical",
    metric: str = "viewCount",
) -> DataFrame:
    """Top bigrams of the high and low tier of every entity in every period.

    ``ties="alphabetical"`` counts with a hash aggregate and is the default.
    ``ties="first_seen"`` keeps the bigram that appears first in the corpus, in
    order of ``order_key`` (a column of the input) and position in the text.
    Input that has ``tokens`` already is not tokenised again.
    """
    by = ["period", "entity", "tier"]
    tiered = with_tiers(in_period, metric)
    first_seen = ties == "first_seen"
    carried = ["order_key"] if first_seen else []
    # tokenise and pair before a video is repeated for its tiers
    text = "tokens" if "tokens" in in_period.columns else "videoTranscript"
    tokenised = tiered.select("period", "tiers", text, *carried)
    if text != "tokens":
        tokenised = with_tokens(tokenised, stopwords)
    in_texts = unnest(tokenised, X.bigrams(F.col("tokens")), "bigram", "_pos")
    pairs = unnest(in_texts, F.col("tiers"), "_t").select(
        "period", "_t.entity", "_t.tier", *carried, "_pos", "bigram"
    )
    frequency = F.count(F.lit(1)).alias("frequency")
    if not first_seen:
        counts = pairs.groupBy(*by, "bigram").agg(frequency)
        return top_per_group(counts, by, n)
    counts = pairs.groupBy(*by, "bigram").agg(frequency, F.min(_place(in_texts)).alias("_first"))
    ranked = top_per_group(counts, by, n, [F.col("frequency").desc(), F.col("_first")])
    return ranked.drop("_first")

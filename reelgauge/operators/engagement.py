"""Periods, entities, engagement thresholds, tiers and summaries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.operators.filters import in_months
from reelgauge.operators.scaling import grouped_quantiles, lookup_join, materialise
from reelgauge.schemas import METRICS

#: Entity that stands for all channels of a period together.
ALL_CHANNELS = "ALL"
HIGH, LOW = "high", "low"


@dataclass(frozen=True)
class Period:
    """A named closed interval; a date as ``end`` means the midnight it starts with."""

    name: str
    start: str
    end: str


# Bounds of the three analysis periods.
PERIODS = (
    Period("nov-dec 2022", "2022-11-01", "2022-12-31"),
    Period("early jan 2023", "2023-01-06", "2023-01-18"),
    Period("late jan 2023 on", "2023-01-19", "2023-03-01"),
)


def _bound(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def assign_periods(
    videos: DataFrame, periods: Sequence[Period] = PERIODS, time: str = "publishedAt"
) -> DataFrame:
    """Add ``period``; a row appears once for every period that contains its time.

    The periods are a short list in the caller's program, so they enter the plan
    as literals: no join, and the overall range is left to the scan to prune by.
    Of a table stored by month only the months of the periods are read.
    """
    at = F.col(time)
    within = [
        F.when(at.between(_bound(p.start), _bound(p.end)), F.lit(p.name)) for p in periods
    ]
    earliest = F.least(*map(_bound, (p.start for p in periods)), _bound(periods[0].start))
    latest = F.greatest(*map(_bound, (p.end for p in periods)), _bound(periods[0].end))
    rows = in_months(videos, [(_bound(p.start), _bound(p.end)) for p in periods], time)
    return rows.filter(at.between(earliest, latest)).withColumn(
        "period", F.explode(F.array_compact(F.array(*within)))
    )


def with_entities(rows: DataFrame) -> DataFrame:
    """Repeat each row for its channel and for all channels together."""
    return rows.withColumn(
        "entity", F.explode(F.array(F.lit(ALL_CHANNELS), F.col("channelId")))
    )


def metric_counts(in_period: DataFrame, metric: str = "viewCount") -> DataFrame:
    """Rows per (period, entity, value), rolled up from the per-channel counts."""
    per_channel = in_period.groupBy("period", "channelId", metric).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        with_entities(per_channel)
        .groupBy("period", "entity", metric)
        .agg(F.sum("n").alias("n"))
    )


def merged_counts(parts: Sequence[DataFrame], metric: str = "viewCount") -> DataFrame:
    """Sum of several tables of ``metric_counts``; values that no row has left vanish."""
    key = ["period", "entity", metric]
    rows = parts[0].select(*key, "n")
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*key, "n"))
    return rows.groupBy(*key).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def counts_change(
    added: DataFrame, removed: DataFrame | None = None, metric: str = "viewCount"
) -> DataFrame:
    """What a batch changes in stored ``metric_counts``: its rows, less those they replace.

    Counts are exact and add up, so limits after a batch come from ``merged_counts`` of
    the stored counts and this, and no older video is read again.
    """
    counts = metric_counts(added, metric)
    if removed is None:
        return counts
    gone = metric_counts(removed, metric).withColumn("n", -F.col("n"))
    return merged_counts([counts, gone], metric)


def engagement_thresholds(in_period: DataFrame, metric: str = "viewCount") -> DataFrame:
    """``high`` and ``low`` limits per period and entity, as ``limits_of_counts`` has them.

    The counts are stored first because the ranking reads them twice.
    """
    return limits_of_counts(materialise(metric_counts(in_period, metric)), metric)


def limits_of_counts(counts: DataFrame, metric: str = "viewCount") -> DataFrame:
    """``high`` and ``low`` limits per period and entity from stored ``metric_counts``.

    More than three videos: the exact 75 % and 25 % quantiles.  Up to three: the
    minimum and one less, which makes every video high and none low.
    """
    q = grouped_quantiles(counts, ["period", "entity"], metric, {"q75": 0.75, "q25": 0.25})
    few = F.col("n") <= 3
    lowest = F.col("lowest").cast("double")
    return q.select(
        "period",
        "entity",
        "n",
        F.when(few, lowest).otherwise(F.col("q75")).alias("high"),
        F.when(few, lowest - 1).otherwise(F.col("q25")).alias("low"),
    )


def _threshold_lookup(thresholds: DataFrame) -> DataFrame:
    """One row per (period, channel) carrying the channel's and the overall limits."""
    overall = thresholds.filter(F.col("entity") == ALL_CHANNELS).select(
        "period", F.col("high").alias("all_high"), F.col("low").alias("all_low")
    )
    channel = thresholds.filter(F.col("entity") != ALL_CHANNELS).select(
        "period",
        F.col("entity").alias("channelId"),
        F.col("high").alias("own_high"),
        F.col("low").alias("own_low"),
    )
    # one row per period of the caller's list: small whatever the data
    return channel.join(F.broadcast(overall), "period")


def with_tiers(
    in_period: DataFrame,
    metric: str = "viewCount",
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """Add ``tiers``: array of (entity, tier) the video belongs to; drop rows with none.

    Limits are inclusive on both sides, so a tie can put a video into both tiers.
    The limits are worked out from the narrow columns and stored first; the wide
    rows then only meet a lookup and are not shuffled while it is small enough.
    """
    if thresholds is None:
        narrow = in_period.select("period", "channelId", metric)
        thresholds = materialise(engagement_thresholds(narrow, metric))
    lookup = _threshold_lookup(thresholds)
    joined = lookup_join(in_period, lookup, ["period", "channelId"], "inner")
    views = F.col(metric)

    def member(condition: Column, entity: Column, tier: str) -> Column:
        return F.when(
            condition, F.struct(entity.alias("entity"), F.lit(tier).alias("tier"))
        )

    everyone, own = F.lit(ALL_CHANNELS), F.col("channelId")
    tiers = F.array_compact(
        F.array(
            member(views >= F.col("all_high"), everyone, HIGH),
            member(views <= F.col("all_low"), everyone, LOW),
            member(views >= F.col("own_high"), own, HIGH),
            member(views <= F.col("own_low"), own, LOW),
        )
    )
    return (
        joined.withColumn("tiers", tiers)
        .filter(F.size("tiers") > 0)
        .drop("all_high", "all_low", "own_high", "own_low")
    )


def explode_tiers(tiered: DataFrame) -> DataFrame:
    """One row per (video, entity, tier)."""
    return tiered.withColumn("_t", F.explode("tiers")).select(
        *[c for c in tiered.columns if c != "tiers"],
        F.col("_t.entity").alias("entity"),
        F.col("_t.tier").alias("tier"),
    )


def tier_sizes(tiered: DataFrame) -> DataFrame:
    return (
        explode_tiers(tiered.select("period", "tiers"))
        .groupBy("period", "entity", "tier")
        .agg(F.count(F.lit(1)).alias("videos"))
    )


# --- summaries ----------------------------------------------------------------

def metric_summary(
    videos: DataFrame, by: Iterable[str] = (), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Number of videos, and mean and maximum of every metric."""
    aggregates = [F.count(F.lit(1)).alias("videos")]
    for m in metrics:
        aggregates += [F.avg(m).alias(f"mean_{m}"), F.max(m).alias(f"max_{m}")]
    return videos.groupBy(*by).agg(*aggregates)


def group_engagement(
    videos: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Mean metrics and number of videos per group, most viewed groups first."""
    return (
        videos.groupBy(*by)
        .agg(
            *[F.avg(m).alias(m) for m in metrics],
            F.count(F.lit(1)).alias("num_videos"),
        )
        .orderBy(F.col(metrics[0]).desc(), *by)
    )


def rounded(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Metrics rounded half to even, as printed."""
    return df.withColumns({m: F.bround(F.col(m), 0) for m in metrics})


def rollup_period_channel(
    in_period: DataFrame, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Videos and mean metrics per channel and for all channels of each period.

    The sums per channel are rolled up a second time, so rows are read once and
    the entity for all channels never gathers them in one place.
    """
    sums = in_period.groupBy("period", "channelId").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in metrics]
    )
    return (
        with_entities(sums)
        .groupBy("period", "entity")
        .agg(
            F.sum("n").alias("videos"),
            *[(F.sum(m) / F.sum("n")).alias(f"mean_{m}") for m in metrics],
        )
    )


def channels_in_period(in_period: DataFrame) -> DataFrame:
    return in_period.select("period", "channelId").distinct()


def topic_count(n: Column) -> Column:
    """Number of topics for a group of ``n`` videos: 1, or between 2 and 5."""
    return F.when(n == 1, F.lit(1)).otherwise(
        F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / 3).cast("int")))
    )


def group_sizes(in_period: DataFrame) -> DataFrame:
    """Videos per period and entity."""
    per_channel = in_period.groupBy("period", "channelId").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        with_entities(per_channel).groupBy("period", "entity").agg(F.sum("n").alias("n"))
    )


def zscores(
    rows: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Add ``z_<metric>``: distance from the group's mean in population deviations."""
    by = list(by)
    key = by or ["_all"]
    keyed = rows if by else rows.withColumn("_all", F.lit(0))
    stats = keyed.groupBy(*key).agg(
        *[F.avg(m).alias(f"_mean_{m}") for m in metrics],
        *[F.stddev_pop(m).alias(f"_dev_{m}") for m in metrics],
    )
    joined = lookup_join(keyed, materialise(stats), key, "inner")
    return joined.select(
        *rows.columns,
        *[
            F.when(F.col(f"_dev_{m}") == 0, F.lit(0.0))
            .otherwise((F.col(m) - F.col(f"_mean_{m}")) / F.col(f"_dev_{m}"))
            .alias(f"z_{m}")
            for m in metrics
        ],
    )

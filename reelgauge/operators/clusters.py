"""K-means over engagement metrics for all groups of a corpus at once.

One model per (period, channel) is wanted.  Rather than fitting them one after
the other, every pass treats all groups and all restarts in the same job: points
meet the few centres of their group, and partial sums are combined before they
travel.  Centres are tiny (``restarts * k`` per group); points are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgauge.operators.engagement import zscores
from reelgauge.operators.scaling import (
    fits,
    lookup_join,
    materialise,
    sized_join,
    unnest,
)
from reelgauge.schemas import METRICS

_AXES = ("x", "y", "z")


def _uniform(*parts: Column) -> Column:
    """Repeatable number in (0, 1) for the given values."""
    bits = F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _squared_distance(a: Column, b: Column) -> Column:
    d = [a[x] - b[x] for x in _AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _moved(m: Column) -> Column:
    """Mean of the points of centre ``m``; a centre that lost all of them stays."""
    same = F.filter(
        F.col("_means"), lambda n: (n["restart"] == m["restart"]) & (n["c"] == m["c"])
    )
    return F.coalesce(F.try_element_at(same, F.lit(1)), m)


def _nearest(centres: Column) -> Column:
    """Struct (d, c) of the centre closest to the row; the lowest number on ties."""
    point = {a: F.col(a) for a in _AXES}
    return F.array_min(
        F.transform(
            centres,
            lambda m: F.struct(_squared_distance(point, m).alias("d"), m["c"].alias("c")),
        )
    )


def _gather(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """One row per group with its centres of all restarts (restarts * k at most)."""
    return rows.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("restart", "c", *_AXES))).alias(name)
    )


def _of_restart(centres: Column, restart: Column) -> Column:
    return F.filter(centres, lambda m: m["restart"] == restart)


def _runs(restarts: int) -> Column:
    return F.sequence(F.lit(0), F.lit(restarts - 1))


def _seed(
    points: DataFrame, by: Sequence[str], k: int, restarts: int, seed: int, small: bool
) -> DataFrame:
    """k-means++ starts.

    Drawing a point with probability proportional to a weight is the same as
    taking the least of ``-ln(u) / weight`` over all points, which is a minimum
    and so combines before the exchange.
    """
    def draw(rows: DataFrame, weight: Column, step: int) -> DataFrame:
        u = _uniform(*[F.col(a) for a in _AXES], "restart", F.lit(step), F.lit(seed))
        race = F.when(weight > 0, -F.log(u) / weight)
        raced = rows.withColumn("_race", race).filter(F.col("_race").isNotNull())
        won = raced.groupBy(*by, "restart").agg(
            F.min_by(F.struct(*_AXES), "_race").alias("_p")
        )
        placed = won.select(
            *by, "restart", F.lit(step).alias("c"), *[f"_p.{a}" for a in _AXES]
        )
        return _gather(placed, by, "_drawn")

    rows = points.withColumn("restart", F.explode(_runs(restarts)))
    state = materialise(draw(rows, F.col("w"), 0).withColumnRenamed("_drawn", "centres"))
    for step in range(1, k):
        rows = sized_join(points, state, by, "inner", small).withColumn(
            "restart", F.explode(_runs(restarts))
        )
        placed = _of_restart(F.col("centres"), F.col("restart"))
        drawn = draw(rows, F.col("w") * _nearest(placed)["d"], step)
        # a group without any point away from its centres gets no further one
        added = F.concat(
            "centres",
            F.coalesce(F.col("_drawn"), F.filter("centres", lambda m: F.lit(False))),
        )
        state = materialise(
            state.join(drawn, list(by), "left").withColumn("centres", added).drop("_drawn")
        )
    return state


def _assign(
    points: DataFrame, state: DataFrame, by: Sequence[str], restarts: int, small: bool
) -> DataFrame:
    """One row per point and restart with its nearest centre in ``_n``."""
    centres = F.col("centres")
    nearest = F.transform(
        _runs(restarts),
        lambda r: F.struct(r.alias("restart"), _nearest(_of_restart(centres, r)).alias("n")),
    )
    met = sized_join(points, state, by, "inner", small)
    return unnest(met.select(*by, *_AXES, "w", nearest.alias("_runs")), F.col("_runs"), "_r").select(
        *by, *_AXES, "w", "_r.restart", F.col("_r.n").alias("_n")
    )


def fit_centres(
    points: DataFrame,
    by: Sequence[str],
    k: int = 3,
    restarts: int = 10,
    seed: int = 42,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> DataFrame:
    """Centres of the best restart per group.

    ``points`` has the group columns, ``x``, ``y``, ``z`` and a weight ``w`` (equal
    points counted together).  A group with fewer than ``k`` distinct points gets
    that many centres.
    """
    by = list(by)
    # the state has one row per group; its number does not change between passes
    small = fits(points.select(*by).distinct())
    state = _seed(points, by, k, restarts, seed, small)
    means = [(F.col(a) / F.col("_w")).alias(a) for a in _AXES]
    weighted = [F.sum(F.col("w") * F.col(a)).alias(a) for a in _AXES]
    centres = F.transform("_old", _moved).alias("centres")
    shift = F.aggregate(
        F.zip_with(F.transform("_old", _moved), "_old", _squared_distance),
        F.lit(0.0),
        lambda total, d: total + d,
    ).alias("_shift")
    done = []
    for _ in range(max_iter):
        sums = (
            _assign(points, state, by, restarts, small)
            .groupBy(*by, "restart", F.col("_n.c").alias("c"))
            .agg(F.sum("w").alias("_w"), *weighted)
        )
        gathered = _gather(sums.select(*by, "restart", "c", *means), by, "_means")
        old = state.withColumnRenamed("centres", "_old")
        moved = materialise(old.join(gathered, by).select(*by, centres, shift))
        # groups that have settled leave the passes, and their points with them
        done.append(moved.filter(F.col("_shift") <= tol).drop("_shift"))
        state = moved.filter(F.col("_shift") > tol).drop("_shift")
        if state.isEmpty():
            break
    for part in done:
        state = state.unionByName(part)
    state = materialise(state)
    inertia = (
        _assign(points, state, by, restarts, small)
        .groupBy(*by, "restart")
        .agg(F.sum(F.col("w") * F.col("_n.d")).alias("inertia"))
    )
    # restarts that differ in the last digits found the same partition
    best = inertia.groupBy(*by).agg(
        F.min_by("restart", F.struct(F.round("inertia", 9), "restart")).alias("_best")
    )
    return state.join(best, by).select(
        *by, _of_restart(F.col("centres"), F.col("_best")).alias("centres")
    )


def cluster_engagement(
    in_period: DataFrame,
    by: Sequence[str] = ("period", "channelId"),
    metrics: Sequence[str] = METRICS,
    k: int = 3,
    restarts: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Add ``cluster`` to the videos of every group with at least three of them.

    Metrics are scaled to unit deviation per group.  Clusters are numbered by
    rising mean of the first metric, which makes the numbers repeatable.
    """
    by, metrics = list(by), list(metrics)
    rows = in_period.dropna(subset=metrics)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    large = materialise(sizes.filter(F.col("_size") >= 3).select(*by))
    kept = lookup_join(rows, large, by, "left_semi")
    scaled = zscores(kept, by, metrics).withColumnsRenamed(
        {f"z_{m}": a for m, a in zip(metrics, _AXES)}
    )
    # copies of a point count once with a weight
    points = materialise(
        scaled.groupBy(*by, *metrics, *_AXES).agg(F.count(F.lit(1)).alias("w"))
    )
    centres = materialise(fit_centres(points, by, k, restarts, seed))
    labelled = lookup_join(points, centres, by, "inner").withColumn(
        "_c", _nearest(F.col("centres"))["c"]
    )
    means = labelled.groupBy(*by, "_c").agg(
        (F.sum(F.col(metrics[0]) * F.col("w")) / F.sum("w")).alias("_mean")
    )
    numbers = means.withColumn(
        "cluster",
        F.row_number().over(Window.partitionBy(*by).orderBy("_mean", "_c")) - 1,
    )
    relabelled = materialise(
        centres.join(
            numbers.groupBy(*by).agg(
                F.map_from_entries(F.collect_list(F.struct("_c", "cluster"))).alias("_no")
            ),
            by,
        )
    )
    placed = lookup_join(scaled, relabelled, by, "inner")
    label = F.element_at("_no", _nearest(F.col("centres"))["c"])
    return placed.withColumn("cluster", label).select(*in_period.columns, "cluster")

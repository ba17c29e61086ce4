"""Building blocks that keep a plan safe when one key holds much of the data."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgauge.session import shared_dir

#: Largest lookup table, in rows, that is sent to every executor.
BROADCAST_ROWS = 200_000
#: Largest one in bytes, fields counted as 16 bytes and texts by their length.
BROADCAST_BYTES = 64 << 20
#: A key is hot when it holds more than this share of the rows (so < 200 keys are).
HOT_SHARE = 200
#: Spark's setting to remove the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables in the shared folder, removed when the block ends.

    ``keep`` writes a table and reads it back, which cuts lineage and survives lost
    executors; ``drop`` removes tables that nothing reads any more.  What outlives the
    block is stored by ``materialise``.  Inside the block the shuffle files of a query go
    as soon as it has run, not when the driver happens to collect its garbage; so a frame
    with a shuffle must not be run twice there, and not be fetched by ``toLocalIterator``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}", 0
        self.kept: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Tables:
        self.before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        return self

    def keep(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            for path in [path for kept, path in self.kept if kept is frame]:
                self._delete(path)
            self.kept = [(kept, path) for kept, path in self.kept if kept is not frame]

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(SHUFFLE_CLEANUP, self.before)
        self._delete(self.path)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if the table has at most that many rows and bytes; reads no more rows than it must.

    Only the size of each row goes to the count, never its texts.
    """
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
    sizes = df.select(size.cast("long").alias("size")).limit(max_rows + 1)
    rows, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def hot_keys(keys: DataFrame, on: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys holding more than 1/``share`` of the rows, hence fewer than ``share`` keys."""
    counts = keys.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).scalar()
    return counts.filter(F.col("_rows") * share > total).select(*on)


def hot_key_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join to a large table with unique keys; rows of hot keys are not shuffled.

    There are fewer than ``HOT_SHARE`` hot keys by construction, so at most as
    many rows of ``table`` belong to them: those are broadcast and meet their rows
    in place.  All other rows take the ordinary shuffle join.  Nothing depends on
    row order, so a task that is run again sends every row where it went before.
    ``how`` is one of inner, left, left_semi and left_anti.  ``hot`` hands in the
    keys where they are known from an earlier pass.
    """
    on = list(on)
    if hot is None:
        hot = materialise(hot_keys(rows.select(*on).dropna(), on))
    if hot.isEmpty():
        return rows.join(table, on, how)
    keys = F.broadcast(hot)
    theirs = F.broadcast(table.join(keys, on, "left_semi"))
    stay = rows.join(keys, on, "left_semi").join(theirs, on, how)
    move = rows.join(keys, on, "left_anti").join(table, on, how)
    return stay.unionByName(move)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join to a table expected to be small: broadcast if it is, hot-key join if not.

    ``table`` has one row per key.
    The size check runs a bounded count, so a table that is costly to compute
    should be materialised first.
    """
    return sized_join(rows, table, on, how, small=fits(table, max_rows))


def sized_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str,
    small: bool,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``lookup_join`` for a table whose size was checked before, as in a loop."""
    if small:
        return rows.join(F.broadcast(table), list(on), how)
    return hot_key_join(rows, table, on, how, hot=hot)


def unnest(df: DataFrame, array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of an array that is costly to compute.

    A plain ``explode`` lets Catalyst infer the filter ``size(array) > 0``, which
    moves down to the scan and evaluates the array's whole expression there once
    more per reference.  The outer form does not, so empty rows are dropped here.
    """
    if position is None:
        out = df.withColumn(name, F.explode_outer(array))
    else:
        out = df.select("*", F.posexplode_outer(array).alias(position, name))
    return out.filter(F.col(name).isNotNull())


# --- exact quantiles ----------------------------------------------------------

_KEPT_BITS = 12


def _value_bucket(value: Column) -> Column:
    """Order-preserving bucket of a long that keeps its 12 leading bits.

    There are at most about 210,000 buckets for the whole range, and a bucket of
    values around v spans v/2048 numbers, so neither side of the split is large.
    """
    def magnitude(v: Column) -> Column:
        shift = F.greatest(F.length(F.bin(v)) - _KEPT_BITS, F.lit(0))
        kept = F.call_function("shiftright", v, shift)
        return shift.cast("long") * (1 << _KEPT_BITS) + kept

    return F.when(value >= 0, magnitude(value)).otherwise(
        -magnitude(-(value + 1)) - 1
    )


def grouped_quantiles(
    counts: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    weight: str = "n",
) -> DataFrame:
    """Exact linearly interpolated quantiles of a long column, per group.

    ``counts`` has one row per group and distinct value with its number of rows.
    The result has the group columns, ``n``, ``lowest`` and one double column per
    entry of ``probabilities``.  No task sees a whole group: bucket totals find
    the buckets that hold the wanted ranks, and only those buckets are ranked.
    """
    by = list(by)
    bucketed = counts.select(
        *by,
        F.col(value).alias("_v"),
        F.col(weight).alias("_n"),
        _value_bucket(F.col(value)).alias("_bucket"),
    )
    totals = bucketed.groupBy(*by, "_bucket").agg(
        F.sum("_n").alias("_n"), F.min("_v").alias("_low")
    )
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    located = totals.select(
        *by,
        "_bucket",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
        F.min("_low").over(group).alias("_lowest"),
    )
    ranks = []
    for p in probabilities.values():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        ranks += [F.floor(position).cast("long"), F.ceil(position).cast("long")]
    wanted = located.select(
        *by,
        "_bucket",
        "_before",
        F.col("_total").alias("n"),
        F.col("_lowest").alias("lowest"),
        F.filter(
            F.array_distinct(F.array(*ranks)),
            lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")),
        ).alias("_ranks"),
    ).filter(F.size("_ranks") > 0)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, -1
    )
    found = (
        bucketed.join(wanted, [*by, "_bucket"])
        .withColumn(
            "_start",
            F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)),
        )
        .withColumn("_rank", F.explode("_ranks"))
        .filter(
            (F.col("_rank") >= F.col("_start"))
            & (F.col("_rank") < F.col("_start") + F.col("_n"))
        )
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col("_v")))

    aggregates, quantiles = [], []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(position).cast("long"), F.ceil(position).cast("long")
        aggregates += [at(low).alias(f"_{name}_lo"), at(high).alias(f"_{name}_hi")]
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        quantiles.append(
            (lo + (hi - lo) * (position - F.floor(position))).cast("double").alias(name)
        )
    return (
        found.groupBy(*by, "n", "lowest")
        .agg(*aggregates)
        .select(*by, "n", "lowest", *quantiles)
    )

"""Classes of texts with equal shingle sets, and from links of classes back to documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.centred import by_group, spanning
from reelgauge.llm.common import Tables, small_batches, text_slices
from reelgauge.llm.components import components
from reelgauge.llm.shingles import shingle_sets, signature
from reelgauge.operators.scaling import materialise

#: Bytes of texts that are cut into shingles at once.
SLICE_BYTES = 1_000_000
#: Bytes of ids, or of a list of tokens, that may travel to all tasks.
TRAVEL = 32_000_000


def classes_of(rows: DataFrame, tables: Tables, *more: str) -> DataFrame:
    """s1, s2, n, rep, cls and ``more``: one row for each distinct set, with a number and its smallest document.

    ``more`` are columns that equal sets have alike.
    """
    found = rows.filter("n > 0").groupBy("s1", "s2").agg(F.min("n").alias("n"), F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in more))
    return tables.keep(found.withColumn("cls", F.monotonically_increasing_id()))


def shared_tokens(listed: DataFrame, classes: DataFrame, tables: Tables) -> DataFrame:
    """token, cls of the tokens that several classes have; ``listed`` has s1, s2, tokens of every class."""
    each = listed.select(F.explode("tokens").alias("token"), "s1", "s2")
    ends = [f(x).alias(f"{n}_{x}") for x in ("s1", "s2") for n, f in (("least", F.min), ("most", F.max))]
    several = each.groupBy("token").agg(*ends).filter("least_s1 <> most_s1 or least_s2 <> most_s2").select("token")
    several = tables.keep(several)
    found = each.join(F.broadcast(several) if several.count() * 16 <= TRAVEL else several, "token").distinct()
    return found.join(classes.select("s1", "s2", "cls"), ["s1", "s2"]).select("token", "cls")


def sifted(groups: DataFrame, values: DataFrame, bound: int, possible: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], tables: Tables) -> DataFrame:
    """grp, cls: groups of at most ``bound`` members fall into what possible pairs connect; others stay.

    ``values`` has cls, n and the array v that ``possible`` looks at, instead of whole sets.
    """
    counts = groups.groupBy("grp").agg(F.count("*").alias("members")).filter("members > 1")
    named = tables.keep(groups.join(counts, "grp"))

    def connected(_: int, members: list) -> Iterator[tuple]:
        good = possible(np.array([m[1] for m in members], np.int64), [m[2] for m in members])
        names: dict[int, int] = {}
        for i, j in spanning(good & ~np.eye(len(good), dtype=bool)):
            names[i] = names[j] = names.get(i, i)
        for i, first in names.items():
            yield members[first][0], members[i][0]

    small = named.filter(F.col("members") <= bound).join(values.select("cls", "n", "v"), "cls")
    joined = by_group(small, ["grp", "cls", "n", "v"], connected, "grp bigint, cls bigint")
    large = named.filter(F.col("members") > bound).select("grp", "cls")
    return tables.keep(joined.select(F.xxhash64("grp").alias("grp"), "cls").union(large).distinct())


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, tables: Tables, size: int) -> DataFrame:
    """cls, n, v (ascending) of the wanted classes, from the texts of their smallest documents.

    Rows of one id may differ: only those of the class's own signature count.
    """
    small_batches(docs.sparkSession)
    named = tables.keep(classes.join(wanted.select("cls").distinct(), "cls", "left_semi"))
    ids = named.select(F.col("rep").alias("_rep")).distinct()
    ids = F.broadcast(ids) if named.count() * 16 <= TRAVEL else ids
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0, SLICE_BYTES):
                sets = [s for s in shingle_sets(part.column(0).to_pylist(), size) if len(s)]
                if sets:
                    marks = [signature(s) for s in sets]
                    yield pa.RecordBatch.from_arrays([
                        *(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)),
                        pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64())),
                    ], ["s1", "s2", "v"])

    found = texts.mapInArrow(run, "s1 bigint, s2 bigint, v array<bigint>")
    marks = named.select("s1", "s2", "cls", "n")
    marks = F.broadcast(marks) if named.count() * 32 <= TRAVEL else marks
    found = tables.keep(found.join(marks, ["s1", "s2"]).select("cls", "n", "v"))
    # repeated rows of a document give its set more than once
    return found if found.count() == named.count() else tables.keep(found.dropDuplicates(["cls"]))


def with_components(rows: DataFrame, classes: DataFrame, links: DataFrame, tables: Tables, *more: str) -> DataFrame:
    """doc_id, n_shingles, component_id and ``more`` of ``rows``; links connect classes (a, b)."""
    roots = tables.keep(components(links, tables).withColumnRenamed("node", "cls"))
    known = tables.keep(classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    lowest = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = known.join(lowest, "root").select("s1", "s2", "cls", "root", "component_id")
    out = rows.join(named, ["s1", "s2"], "left")
    component = F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id").alias("component_id")
    return materialise(out.select("doc_id", F.col("n").alias("n_shingles"), component, *more))

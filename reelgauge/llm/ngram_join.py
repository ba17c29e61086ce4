"""Jaccard join of word shingles by prefix filters under several global orders.

Two sets that are similar enough share an element of their prefixes under every order of
all shingles.  Frequent shingles come last in each of three orders, which differ in the
rest.  Classes of equal sets that share prefix elements under an order fall into a group
of that order; candidates must meet in a group of the first and of the second order, and
have company under the third.  The filters are intersected as keys of groups, before any
pair exists: first inside each group of the first order, by how many prefix elements its
members share there, then with the other orders.  What is left of a group is compared
exactly, by ``centred`` if it is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgauge.llm.centred import CENTRED, common_elements, labelled, links_of
from reelgauge.llm.common import Tables, small_batches, text_slices
from reelgauge.llm.shingles import shingle_sets, signature
from reelgauge.llm.text_classes import SLICE_BYTES, classes_of, sets_of, shared_tokens, sifted, with_components

SHINGLE, PERCENT = 5, 80
#: The counting sketch: counters in all, and parts in which it travels; counters that a task holds at most, about.
SKETCH_BITS, SKETCH_PARTS, SKETCH_HELD = 26, 64, 1_500_000
#: A shingle is frequent from this count on, or this many deviations above a counter's mean.
LEAST_FREQUENT, DEVIATIONS = 24, 4
#: Odd factors of the global orders.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_U = np.uint64


class Bits:
    """A map of bits that is read like an array of truth values."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def __getitem__(self, place: np.ndarray) -> np.ndarray:
        return (self.packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def prefix(shingles: np.ndarray, frequent: np.ndarray | Bits, order: int, percent: int = PERCENT) -> np.ndarray:
    """The first shingles under one order: any similar set has one of them in its own prefix."""
    n = len(shingles)
    late = frequent[(shingles >> _U(64 - SKETCH_BITS)).astype(np.int64)]
    rank = shingles * _U(ORDERS[order])
    length = n - (percent * n + 99) // 100 + 1
    return shingles[np.lexsort((rank, late))[:length]]


# --- first pass: set sizes, signatures, and the counting sketch -----------------


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counters in order, each once, with their sums."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[start], np.add.reduceat(np.concatenate(counts)[order], start)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Counters of a part, ascending: their number, steps to the next one and counts, byte by byte."""
    both = np.stack([np.diff(keys, prepend=0), counts]).astype("<u4")
    return len(keys).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)), "zstd", asbytes=True)


def _add(counts: np.ndarray, blob: bytes) -> None:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(2, 4, n)
    steps, number = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0]
    counts[np.cumsum(steps, dtype=np.int64)] += number


def _first_pass(docs: DataFrame, size: int) -> DataFrame:
    """Rows of documents (part null) with sizes and signatures, and the parts of the tasks' sketches."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ["n", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, schema = [], [], 0, None

        def sketch() -> pa.RecordBatch:
            key, count = _merged(keys, counts)
            width = (1 << SKETCH_BITS) // SKETCH_PARTS
            edge = np.searchsorted(key, np.arange(SKETCH_PARTS + 1) * width)
            parts = [p for p in range(SKETCH_PARTS) if edge[p] < edge[p + 1]]
            blobs = [_pack(key[edge[p] : edge[p + 1]] - p * width, count[edge[p] : edge[p + 1]]) for p in parts]
            nothing = pa.nulls(len(parts), pa.int64())
            return pa.RecordBatch.from_arrays([
                pa.nulls(len(parts), schema.field(0).type), *([nothing] * len(longs)), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary()),
            ], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("doc_id", batch.column(0).type), *((c, pa.int64()) for c in longs), ("part", pa.int32()), ("blob", pa.binary())])
            for piece in text_slices(batch, 1, SLICE_BYTES):
                sets = shingle_sets(piece.column(1).to_pylist(), size)
                where, number = np.unique((np.concatenate(sets) >> _U(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
                keys.append(where)
                counts.append(number.astype(np.uint32))
                held += len(where)
                marks = [signature(s) for s in sets]
                rows = len(sets)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)),
                    pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()),
                ], schema=schema)
                if held > SKETCH_HELD:
                    yield sketch()
                    keys, counts, held = [], [], 0
        if held:
            yield sketch()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in longs)}, part int, blob binary")


def _frequent(sketch: DataFrame, total: int) -> Bits:
    """Which counters are frequent: one bit each, a map of fixed size, whatever the input.

    At most ``total / limit`` counters can be; chance alone lifts few so far above the mean,
    and one that it lifts only comes later in every order.
    """
    mean = total / (1 << SKETCH_BITS)
    limit = max(LEAST_FREQUENT, round(mean + DEVIATIONS * mean**0.5))
    width = (1 << SKETCH_BITS) // SKETCH_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part not in sums:
                    sums[part] = np.zeros(width, np.int64)
                _add(sums[part], blob)
        if sums:
            bits = [np.packbits(c >= limit).tobytes() for c in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["part", "bits"])

    out = np.zeros((SKETCH_PARTS, width // 8), np.uint8)
    summed = sketch.select("part", "blob").repartition(SKETCH_PARTS, "part").mapInArrow(run, "part int, bits binary")
    for row in summed.collect():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return Bits(out.reshape(-1))


# --- second pass: prefixes --------------------------------------------------------


def _prefixes(docs: DataFrame, frequent: Bits, size: int, percent: int) -> DataFrame:
    """s1, s2, tokens: each class's prefix under the first order, once from each task that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for piece in text_slices(batch, 0, SLICE_BYTES):
                own = {}
                for s in shingle_sets(piece.column(0).to_pylist(), size):
                    mark = signature(s) if len(s) else None
                    if mark is not None and mark not in seen:
                        seen.add(mark)
                        own[mark] = prefix(s, frequent, 0, percent).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array([m[i] for m in own], pa.int64()) for i in (0, 1)), pa.array(list(own.values()), pa.list_(pa.int64()))], ["s1", "s2", "tokens"])

    return docs.select("text").mapInArrow(run, "s1 bigint, s2 bigint, tokens array<bigint>")


def _tokens_of(sets: DataFrame, frequent: Bits, percent: int) -> DataFrame:
    """cls, order, token: the prefixes of known sets under the orders behind the first."""
    small_batches(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for order in range(1, len(ORDERS)):
                found = [prefix(v.values.to_numpy().view(np.uint64), frequent, order, percent).view(np.int64) for v in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([order] * len(found), pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["cls", "order", "tokens"])

    arrays = sets.select("cls", "v").mapInArrow(run, "cls bigint, order int, tokens array<bigint>")
    return arrays.select("cls", "order", F.explode("tokens").alias("token"))


def enough(percent: int) -> Callable[[np.ndarray, list[np.ndarray]], np.ndarray]:
    """Which pairs of prefixes have as many elements in common as their sets' sizes ask for.

    Of the two, take the one whose prefix ends first in the order: what they share up to
    there is counted, and behind it that set has only its other elements to share.
    """

    def possible(sizes: np.ndarray, prefixes: list[np.ndarray]) -> np.ndarray:
        least, most = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
        needed = -(-percent * (least + most) // (100 + percent))
        behind = -(-percent * most // 100) - 1
        return (100 * least >= percent * most) & (common_elements(prefixes) + behind >= needed)

    return possible


def _in_company(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key more than one class has; each class has a key once."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key), key, "left_semi")


def _met(first: DataFrame, sets: DataFrame, frequent: Bits, percent: int, tables: Tables) -> DataFrame:
    """grp, cls: the groups of the first order, cut down by the groups of the others."""
    with Tables(sets.sparkSession) as own:
        tokens = own.keep(_tokens_of(sets, frequent, percent))
        of = [_in_company(tokens.filter(F.col("order") == o).select("token", "cls"), "token") for o in range(1, len(ORDERS))]
        second = labelled(of[0], own).withColumnRenamed("grp", "other")
        both = first.join(second, "cls").join(of[1].select("cls").distinct(), "cls", "left_semi")
        return tables.keep(_in_company(both.select(F.xxhash64("grp", "other").alias("grp"), "cls").distinct(), "grp"))


def class_name(first: str = "s1", second: str = "s2") -> F.Column:
    """Both halves of a signature as text: equal for equal sets."""
    return F.concat_ws(":", F.col(first).cast("string"), F.col(second).cast("string"))


def with_class(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` and ``cls``, the class of the text; null for a text without words."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    schema = docs.withColumn("cls", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, place, SLICE_BYTES):
                classes = ["{}:{}".format(*signature(s)) if len(s) else None for s in shingle_sets(piece.column(place).to_pylist(), size)]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(classes, pa.string())], [*piece.schema.names, "cls"])

    return docs.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, classed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Words are runs without ASCII white space, A-Z in lower case; a text of fewer than
    ``size`` words is one shingle, one without words (or null) has none and stays alone.
    Two rows are linked when ``100 * common >= percent * union`` of their sets;
    ``component_id`` is the smallest doc_id reachable, its own included.  Repeated rows
    are linked and each has its row; other columns are ignored; null ids never are the
    smallest while another id is there.  ``classed`` adds the class of the row's text and
    the root of its component, which tell rows of null or repeated ids apart.
    """
    docs = docs.select("doc_id", "text")
    with Tables(docs.sparkSession) as tables:
        first = tables.keep(_first_pass(docs, size))
        rows = tables.keep(first.filter(F.col("part").isNull()).select("doc_id", "n", "s1", "s2"))
        total = rows.agg(F.sum("n")).first()[0] or 0
        frequent = _frequent(first.filter(F.col("part").isNotNull()), total)
        tables.drop(first)
        classes = classes_of(rows, tables)
        with Tables(docs.sparkSession) as inner:
            prefixes = inner.keep(_prefixes(docs, frequent, size, percent))
            shared = inner.keep(shared_tokens(prefixes, classes, inner))
            inner.drop(prefixes)
            own = shared.groupBy("cls").agg(F.array_sort(F.collect_list("token")).alias("v")).join(classes.select("cls", "n"), "cls")
            groups = tables.keep(sifted(labelled(shared, inner), inner.keep(own), CENTRED, enough(percent), inner))
        sets = sets_of(docs, classes, groups, tables, size)
        groups = _met(groups, sets, frequent, percent, tables)
        links = links_of(groups, sets, percent, tables)
        more = [F.when(F.col("n") > 0, class_name()).alias("cls"), "root"] if classed else []
        return with_components(rows, classes, links, tables, *more)

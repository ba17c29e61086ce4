"""Near-duplicate documents by bottom-k sketches from one hash function.

A sketch holds the k lowest hashes of a document's shingles, the retained values.  Similar
sets share most of them, so a document needs inverted lists only of its rarest ones: of k
values of which ``SHARED`` are surely common to both, one is among the k - SHARED + 1
rarest of either.  Documents that meet in a list are estimated by the k lowest values of
both sketches together, which are the sketch of the union; what is not far below the
threshold is compared in full.  Equal sets are one class from the start, and lists of any
length are worked through by ``centred``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgauge.llm.centred import WHOLE, labelled, links_of
from reelgauge.llm.common import Tables, small_batches, text_slices
from reelgauge.llm.shingles import shingle_sets, signature
from reelgauge.llm.text_classes import SLICE_BYTES, TRAVEL, classes_of, sets_of, sifted, with_components

SHINGLE, PERCENT = 5, 85
#: Values of a sketch, and the share of them that similar sets surely have in common: fewer
#: than half of 64 is eleven deviations below what a similarity of 0.85 gives.
SKETCH, SHARED = 64, 0.5
#: How far below the threshold an estimate may be: seven deviations of a sketch this long.
MARGIN = 0.32


def sketch_rows(docs: DataFrame, size: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """doc_id, n, s1, s2, sketch: set size, signature and k lowest hashes of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                sets = shingle_sets(part.column(1).to_pylist(), size)
                marks = [signature(s) for s in sets]
                low = [np.sort(s.view(np.int64))[:k] for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)),
                    pa.array(low, pa.list_(pa.int64())),
                ], ["doc_id", "n", "s1", "s2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, s1 bigint, s2 bigint, sketch array<bigint>")


def estimates(sets: list[np.ndarray], k: int = SKETCH) -> np.ndarray:
    """Estimated similarity of each pair of ascending sets from their k lowest hashes."""
    low = [s[:k] for s in sets]
    values, element = np.unique(np.concatenate(low), return_inverse=True)
    has = np.zeros((len(sets), len(values)), bool)
    has[np.repeat(np.arange(len(sets)), [len(s) for s in low]), element] = True
    out = np.ones((len(sets), len(sets)))
    for i in range(len(sets)):
        either = has[i] | has[i + 1 :]
        union = either & (np.cumsum(either, axis=1) <= k)
        out[i, i + 1 :] = (union & has[i] & has[i + 1 :]).sum(1) / np.maximum(1, union.sum(1))
    return np.minimum(out, out.T)


def listed(classes: DataFrame, tables: Tables) -> DataFrame:
    """token, cls: the rarest retained values of each class, as far as other classes have them.

    Values are ranked by the length of their lists.
    """
    each = classes.select("cls", "n", F.explode("sketch").alias("token"))
    lengths = tables.keep(each.groupBy("token").agg(F.count("*").alias("length")).filter("length > 1"))
    lengths = F.broadcast(lengths) if lengths.count() * 24 <= TRAVEL else lengths
    retained = F.least(F.col("n"), F.lit(SKETCH))
    needed = retained - F.floor(SHARED * retained) + 1
    own = Window.partitionBy("cls")
    ranked = each.join(lengths, "token").select(
        "token", "cls", F.row_number().over(own.orderBy("length", "token")).alias("rank"), (retained - F.count("*").over(own)).alias("alone"), needed.alias("needed")
    )
    return ranked.filter("alone + rank <= needed").select("token", "cls")


def likely(percent: int) -> Callable[[np.ndarray, list[np.ndarray]], np.ndarray]:
    """Which pairs of sketches may be of similar sets: by size, then by the estimate."""

    def possible(sizes: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
        good = 100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes)
        return good & (estimates(sketches) >= percent / 100 - MARGIN)

    return possible


def near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Words are runs without ASCII white space, A-Z in lower case; a text of fewer than
    ``size`` words is one shingle, one without words (or null) has none and stays alone.
    Two rows are linked when ``100 * common >= percent * union`` of their sets;
    ``component_id`` is the smallest doc_id reachable, its own included, and ``kept`` says
    that it is the row's own.  Repeated rows are linked and each has its row; null ids
    never are the smallest while another id is there, and a component of null ids alone
    keeps all of them (``kept`` null).  Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    with Tables(docs.sparkSession) as tables:
        rows = tables.keep(sketch_rows(docs, size))
        classes = classes_of(rows, tables, "sketch")
        groups = labelled(listed(classes, tables), tables)
        groups = sifted(groups, classes.withColumnRenamed("sketch", "v"), WHOLE, likely(percent), tables)
        sets = sets_of(docs, classes, groups, tables, size)
        links = links_of(groups, sets, percent, tables)
        out = with_components(rows.select("doc_id", "n", "s1", "s2"), classes, links, tables)
        return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgauge.operators.scaling import Tables as Tables

#: Rows of one Arrow batch: a batch of very long texts must fit beside the model in a worker.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; texts may be a thousand times the mean length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # workers that see this folder find the package; elsewhere it is installed or sent with --py-files
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def held_out(doc_id: Column | str) -> Column:
    """True for the third of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]]
) -> DataFrame:
    """Apply a function of Arrow batches to every partition, without moving rows.

    ``make`` runs once per task and returns the function; that one takes a batch
    and returns the columns of its result by name.
    """
    small_batches(df.sparkSession)
    target = pa.schema(
        [pa.field(f.name, _arrow(f.dataType)) for f in _struct(schema)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            columns = apply(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) for f in target], schema=target
            )

    return df.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, place: int, chars: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most so many bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > chars:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield batch.slice(begin)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside many others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)

"""Bounded samples of labelled documents, for the models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgauge.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, max_labels: int, max_chars: int) -> list[tuple[str, object]]:
    """(text, label) of at most ``per_label`` documents of each label.

    More than ``max_labels`` labels are an error, as a model that leaves some out could never
    predict them.  ``labels`` has doc_id and label.  Held-out documents, null labels and texts that are
    empty or longer than ``max_chars`` take no part.  All labels are counted; a hash of
    the id below a label's share makes the choice, the same at every run, so that no
    label's rows meet in one task.  At most ``max_labels * per_label`` texts of that length
    reach the driver.
    """
    known = labels.select("doc_id", "label").filter(~held_out("doc_id") & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy("label").count().limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels to learn: fit fewer at a time or raise the bound")
    if not counts:
        return []
    # twice as many as wanted, as some texts turn out too long
    share = F.lit(None).cast("double")
    for label, n in sorted(counts):
        share = F.when(F.col("label") == F.lit(label), F.lit(2 * per_label / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    drawn = known.filter(draw < share * (1 << 30)).withColumn("draw", draw)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw", "doc_id"))
    ids = drawn.withColumn("rank", rank).filter(F.col("rank") <= 2 * per_label).select("doc_id", "label", "draw")
    kept = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)
    texts = docs.filter(F.length("text").between(1, max_chars)).select("doc_id", "text").join(F.broadcast(kept), "doc_id")
    # an id that comes many times counts once; only what is taken travels
    once = texts.groupBy("label", "draw", "doc_id").agg(F.min("text").alias("text"))
    taken = once.withColumn("rank", rank).filter(F.col("rank") <= per_label).select("text", "label", "draw", "doc_id").toArrow()
    order = taken.sort_by([("draw", "ascending"), ("doc_id", "ascending")])
    return list(zip(order.column("text").to_pylist(), order.column("label").to_pylist(), strict=True))

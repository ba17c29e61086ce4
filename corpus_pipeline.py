"""Corpus pipeline: toxicity, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame; ``run`` writes each result as Parquet and rereads it for the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgauge.llm import langid, ngram_join, packing, pii, toxicity
from reelgauge.llm.common import table
from reelgauge.session import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold; the network learns from the labels of ``docs``.

    The decision is made in the pass that reads the texts, so no row is joined or moved.
    """
    net = toxicity.fit_documents(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), net)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter: only ``und``, a text without any, goes.

    Each other text gets the language the model finds likeliest, and no score is too low.
    """
    return langid.keep_known(docs.select(*COLUMNS), langid.fit_documents(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows without words have no group and stay; of repeated rows, those of one id and one
    set of shingles, one stays.  Null ids come last and are told apart by their texts.
    """
    docs = docs.select(*COLUMNS)
    found = ngram_join.near_duplicates(docs, classed=True)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "cls")).alias("first")
    first = found.filter("n_shingles > 0").groupBy("root").agg(least).select("first.doc_id", "first.cls")
    kept = first.union(found.filter("n_shingles = 0").select("doc_id", "cls").distinct())
    # ids that name one text need no look at it
    many = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("cls").alias("n"), F.count("*").alias("all"))
    many = many.filter("a <> b or n > 0 and n < all").select("doc_id")
    out = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").join(many, "doc_id", "left_anti")
    out = out.withColumn("_rank", F.row_number().over(_by_id())).filter("_rank = 1").select(*COLUMNS)
    if found.filter("doc_id is null").isEmpty() and many.isEmpty():
        return out
    doubtful = docs.filter("doc_id is null").union(docs.join(many, "doc_id", "left_semi").select(*COLUMNS))
    doubtful = ngram_join.with_class(doubtful).withColumn("_plain", F.when(F.col("cls").isNull(), F.col("text")))
    one = doubtful.groupBy("doc_id", "cls", "_plain").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("_row"))
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("cls").alias("_cls"))
    one = one.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("cls").eqNullSafe(F.col("_cls")), "left_semi")
    return out.union(one.select("doc_id", "_row.*").select(*COLUMNS))


def _by_id():
    from pyspark.sql.window import Window

    return Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), "source", "lang", "n_chars")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; n_chars follows the text."""
    done = pii.pseudonymise(docs.select(*COLUMNS), found="__pii").drop("__pii")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length; see ``packing.pack``."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


#: No SQL can express the trained stages; tests/llm checks each stage by brute force.
ORACLE_SQL = None

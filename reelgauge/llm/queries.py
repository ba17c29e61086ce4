"""The registered queries of this package, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgauge.llm import alignment, bm25, bpe, html_text, langid, licenses, minhash, ngram_join, packing, phrases, pii, spotsigs, toxicity
from reelgauge.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the rewritten text, and how many values of each kind were replaced."""
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        # a function of one argument: a second one would be taken for the place in the array
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).alias(f"n_{kind}")

    counts = (count(kind) for kind in pii.FORMS)
    return done.select("doc_id", "text", F.size("pii").alias("n_values"), *counts)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("bucket")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.filter(F.col("doc_id") % 100 == 0))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_ngram_jaccard_join, op3_license_scan, op4_pii_pseudonyms, op5_byte_bpe,
        op6_packing, op7_html_text, op8_toxicity, op9_spotsigs, op10_bm25_top_k,
        op11_phrase_collocations, op12_minhash_near_dedup, op13_cross_tokenizer_alignment,
    )
}

#: DuckDB statements: the other operators can't be said in SQL as a whole (trained models,
#: tokenizers, rule tables, reachability, tie-exact floating sums); tests/llm has their brute force.
ORACLE_SQL: dict[str, str] = {"op11_phrase_collocations": phrases.SQL}

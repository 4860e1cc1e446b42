"""The registered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, decontamination, html_text, jaccard, language, licences, negatives, packing, quality, resampling, substrings, token_store, warc
from .common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_power_of_two(table(spark, sf_dir, "documents"), vocabulary()))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_store.read_documents(token_store.write_token_store(docs, vocabulary()), docs)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan_licences(table(spark, sf_dir, "documents")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.digest(quality.apply_rules(docs, quality.learn_rules(docs, table(spark, sf_dir, "labels"))))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.write_archive(table(spark, sf_dir, "pages")))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.digest(resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.digest(best_fit.pack_best_two_fit(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_token_store, op4_licences, op5_html_text, op6_language, op7_quality, op8_substrings, op9_jaccard, op10_warc, op11_negatives, op12_resampling, op13_best_fit)}

#: Queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {"op9_jaccard": jaccard.ORACLE, "op10_warc": warc.ORACLE, "op11_negatives": negatives.ORACLE, "op12_resampling": resampling.ORACLE}

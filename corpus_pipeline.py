"""A corpus pipeline of five operators; each stage's table is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontamination, jaccard, language, packing, substrings
from leafmill.llm.common import drop, run_folder, sized_broadcast, stage, table, workspace
from leafmill.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of ids (8 bytes each) up to which a list of documents to drop is broadcast.
BROADCAST_ROWS = 500_000
#: Documents whose predicted language won by less than this are rejected: 0.5 is a lost duel.
MIN_SCORE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for each row (_row), written so that it stays: ids may be null or there twice."""
    return stage(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "keyed")[0]


def _by_row(docs: DataFrame) -> DataFrame:
    """What operators read, with the row's key for its id."""
    return docs.select(F.col("_row").alias("doc_id"), "text")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Keyed documents whose row isn't among ``rows`` (_row)."""
    gone, _ = stage(rows.distinct(), "dropped")
    return docs.join(sized_broadcast(gone, BROADCAST_ROWS), "_row", "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language: those without letters, those like no learned language and, where a level has three
    classes or more, those whose language lost a duel go. Short texts, texts mixed of learned languages and some of close
    relatives of a learned language can't be told and stay."""
    model = language.learn(docs)
    found = language.identify(docs.select(*COLUMNS), model, COLUMNS, strict=True)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id (null is the largest), of equal ids any one.
    Rows with one doc_id and texts that are no near copies all stay."""
    docs = _keyed(docs)
    found, _ = stage(jaccard.similar_documents(_by_row(docs)).select(F.col("doc_id").alias("_row"), "component_id"), "similar")
    named, _ = stage(found.join(docs.select("_row", "doc_id"), "_row"), "similar-named")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = named.groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    return _without(docs, named.select("_row").join(first.select("_row"), "_row", "left_anti"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that are there elsewhere too."""
    found = substrings.dedup_substrings(docs.select(*COLUMNS))
    return found.select("rest.doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    # Whether a row leaks follows from its text alone: a hash of the text is its key, and nothing is written again.
    docs = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("text"))
    leaks = decontamination.find_leaks(_by_row(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs, leaks.select(F.col("doc_id").alias("_row")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths."""
    return packing.digest(packing.pack_power_of_two(docs, vocabulary()))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: The first stage's learned model can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again before the next. What a stage stages for itself
    goes when it is written, its table when the next one is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage_function in STAGES:
        path = workspace(spark, f"stage-{name}")
        with run_folder(spark, name):
            made = stage_function(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if last:
            drop(spark, last)
        last = path
    return docs

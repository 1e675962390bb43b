"""Corpus pipeline: five training-data operators over ``documents``, each stage on all that the one before kept.

Language ID drops documents without a language, near-duplicate detection keeps one document
of each group, decontamination drops documents that overlap a benchmark item, the secret
scan masks what it finds in the texts, and BPE encodes them. Every stage's result is
written as Parquet and read again as the next one's documents.

Nulls, empty texts, ties, repeated rows, empty tables and extra columns have the results
that each operator's module states; rows that repeat a document's id and text leave the
near-duplicate stage once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, decontam, lang_id, minhash, secrets
from orrery.llm.common import materialize, release
from orrery.llm.queries import small_batches, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MASK = "[secret]"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; it learns from those with a known one."""
    small_batches(spark)
    model = lang_id.learn(docs)
    return lang_id.predict(docs.select(*COLUMNS), model).where("lang_pred <> 'und'").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows are told apart by id and text together: a text whose id is kept for another text stays out.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS).withColumn("__text", F.xxhash64("doc_id", "text"))
    kept = minhash.near_duplicates(docs, carry=["__text"]).where("kept")
    found = materialize(kept.groupBy(F.col("doc_id").alias("kept_id"), F.col("__text").alias("kept_text")).agg(F.count("*").alias("n")), what="kept")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("__text") == F.col("kept_text"))
    rows = docs.join(found, same).select(*COLUMNS, "n")
    if found.where("n > 1").isEmpty():
        return rows.drop("n")
    # rows that repeat an id and a text leave once
    once = rows.where("n > 1").groupBy("doc_id", "text").agg(*[F.min(c).alias(c) for c in COLUMNS[2:]])
    return rows.where("n = 1").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    small_batches(spark)
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every secret masked; n_chars follows the text where it changed."""
    small_batches(spark)
    found = secrets.find_secrets(docs.select(*COLUMNS), redact=MASK)
    changed = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of ids, and the digests of ids and decoded text."""
    small_batches(spark)
    return bpe.encode(docs.select("doc_id", "text"), tokenizer_path(), keep=["doc_id"], output="digests")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("bpe", tokenize),
]

#: Language models, sketches and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, and goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, what=f"stage-{name}")
            if before is not None:
                release(before)
            before = docs
    return docs

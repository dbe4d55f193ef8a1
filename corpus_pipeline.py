"""A training-data pipeline over documents: each stage's Parquet is the next one's input.

Toxic documents go, one document of each group of near-duplicates stays, documents that hold benchmark items go,
secrets are redacted, and what is left is tokenised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, jaccard_join, secret_scan, toxicity
from corpusmill.llm.common import crc_mod, table, written
from corpusmill.llm.sentencepiece_codec import encode


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 3) != 1)
    return toxicity.keep(docs, toxicity.learn(docs, labels))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates share four fifths of their five-word shingles; op7 asks for nine tenths of three words."""
    return jaccard_join.one_of_each(docs, k=5, least=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas), decoded_sha256."""
    import public_tokenizers

    coded = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids_as_text=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard", no_near_duplicates),
    ("decontaminate", no_benchmark),
    ("secret_scan", no_secrets),
    ("sentencepiece", tokenised),
]

#: Trained, iterative and tokenising stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

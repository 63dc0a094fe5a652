"""The corpus pipeline: quality rules, near-dedup, passage dedup, mixing, encoding.

Each stage takes and (but for the last) returns rows with the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.llm.bpe_chunks import encode_decode
from locusloom.llm.common import read, workers_find_package, written
from locusloom.llm.fair_mix import mix
from locusloom.llm.isolation import quality_verdicts
from locusloom.llm.paragraphs import repeated_passages, without_passages
from locusloom.llm.queries import vocabulary
from locusloom.llm.superminhash import near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows without an id leave here."""
    workers_find_package(spark)
    kept = quality_verdicts(docs, read(spark, sf_dir, "labels")).filter("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id."""
    workers_find_package(spark)
    kept = near_duplicates(docs, words=5, percent=80).filter("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has, and their new lengths; those of which nothing is left leave."""
    workers_find_package(spark)
    cut = without_passages(docs, repeated_passages(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    workers_find_package(spark)
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts, as digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    workers_find_package(spark)
    return encode_decode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Isolation forests, min-hash signatures and tokenizers are beyond SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    workers_find_package(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs

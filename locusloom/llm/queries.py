"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fill_middle, filter_audit, license_scan
from .common import read, scratch_path, workers_find_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_find_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_bit_planes")
def op1_bit_planes(spark, sf):
    """Ids of all documents, stored as byte planes and read back."""
    from .binary_ids import read_planes, write_planes

    path = scratch_path(spark, "planes")
    write_planes(read(spark, sf, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_planes(spark, path)


@query("op4_bpe_chunks")
def op4_bpe_chunks(spark, sf):
    """Ids and decoded texts of all documents, as digests."""
    from .bpe_chunks import encode_decode

    return encode_decode(read(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op7_piece_counts")
def op7_piece_counts(spark, sf):
    """Words and greedy word pieces of all documents."""
    from .wordpiece import piece_counts

    return piece_counts(read(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op3_fair_mix")
def op3_fair_mix(spark, sf):
    """Words the mix takes of each document."""
    from .fair_mix import mix_counts

    return mix_counts(read(spark, sf, "documents"))


@query("op6_isolation")
def op6_isolation(spark, sf):
    """Quality counts and verdicts of all documents."""
    from .isolation import quality_verdicts

    return quality_verdicts(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op8_superminhash")
def op8_superminhash(spark, sf):
    """Near-duplicate components of all documents: three-word shingles at 0.85."""
    from .superminhash import near_duplicates

    return near_duplicates(read(spark, sf, "documents"), words=3, percent=85)


@query("op9_spherical")
def op9_spherical(spark, sf):
    """Near-duplicate components of all embeddings at cosine 0.95."""
    from .spherical import near_duplicate_vectors

    return near_duplicate_vectors(read(spark, sf, "embeddings"))


@query("op10_toxicity")
def op10_toxicity(spark, sf):
    """Toxicity of all documents by a model of the labels that are not held out."""
    from .toxicity import score_texts, train

    docs = read(spark, sf, "documents")
    return score_texts(docs, train(docs, read(spark, sf, "labels")))


@query("op5_ppm")
def op5_ppm(spark, sf):
    """Log probabilities of all documents by a trained byte-context trie, beside a base score."""
    from .ppm import lm_scores

    return lm_scores(read(spark, sf, "documents"))


@query("op2_paragraphs")
def op2_paragraphs(spark, sf):
    """Repeated passages of all documents that dedup removes."""
    from .paragraphs import repeated_passages

    return repeated_passages(read(spark, sf, "documents"))


@query("op11_fill_middle", sql=fill_middle.ORACLE)
def op11_fill_middle(spark, sf):
    """All documents with their middle moved to the end, as digests of output and restored text."""
    return fill_middle.fill_in_middle_digests(read(spark, sf, "documents"))


@query("op12_license_scan", sql=license_scan.oracle())
def op12_license_scan(spark, sf):
    """Licence labels of all documents by signature rules, and counts of the fixed phrases."""
    return license_scan.license_scan(read(spark, sf, "documents"))


@query("op13_filter_audit", sql=filter_audit.ORACLE)
def op13_filter_audit(spark, sf):
    """What each of five filters removes from every source, in every order of the filters."""
    return filter_audit.filter_audit(read(spark, sf, "documents"), read(spark, sf, "labels"))

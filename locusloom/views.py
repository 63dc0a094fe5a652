"""Interval, signal, map and sequence views over the driver tables, for queries and benchmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chrom(column: str):
    return F.concat(F.lit("chr"), (F.col(column) % 5).cast("string"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as regions; the name spells out the row because shorter keys collide."""
    start = (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 13).cast("bigint")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        _chrom("l_suppkey").alias("chrom"),
        start.alias("start"),
        (start + (F.col("l_quantity") * 2).cast("bigint")).alias("end"),
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("name"),
        F.col("l_quantity").alias("score"),
    )


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as regions of interest."""
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select(
            _chrom("o_custkey").alias("chrom"),
            (F.col("o_orderkey") * 100).alias("start"),
            (F.col("o_orderkey") * 100 + 40).alias("end"),
            F.concat(F.lit("roi"), F.col("o_orderkey")).alias("name"),
        )
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as alignment blocks, disjoint on both sides."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("blockid"),
        _chrom("o_custkey").alias("tchrom"),
        (key * 100).alias("tstart"),
        (key * 100 + 60).alias("tend"),
        F.concat(F.lit("q"), (key % 3).cast("string")).alias("qchrom"),
        (key * 80).alias("qstart"),
        (key * 80 + 60).alias("qend"),
        F.when(key % 4 == 0, -1).otherwise(1).alias("qstrand"),
    )


def target_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select(
        F.col("tchrom").alias("chrom"),
        F.col("tstart").alias("start"),
        F.col("tend").alias("end"),
        F.concat(F.lit("block"), F.col("blockid")).alias("name"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signal tracks, one sample per event type; runs of different samples differ in length."""
    start = F.floor(F.col("event_id") / 25).cast("bigint") * 3750
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("sample"),
            _chrom("user_id").alias("chrom"),
            start.alias("start"),
            (start + 1000 + 100 * F.length("event_type")).alias("end"),
        )
        .agg(F.round(F.sum("value"), 3).alias("value"))
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track: the samples added up."""
    return tracks(spark, sf_dir).groupBy("chrom", "start").agg(F.max("end").alias("end"), F.round(F.sum("value"), 3).alias("value"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosome sizes: past the last region, run and block."""
    tables = [regions(spark, sf_dir), tracks(spark, sf_dir), target_blocks(spark, sf_dir)]
    ends = reduce(DataFrame.unionByName, [t.select("chrom", "end") for t in tables])
    return ends.groupBy("chrom").agg((F.max("end") + 100).alias("size"))


_LETTERS = "bdefhijklmnopqrsuvwxyzBDEFGHIJKLMOPQRSUVWXYZ"
_BASES = "acgtacgtacgtacgtacgtacACGTACGTACGTACGTACGTA"


def _spelled(text: str):
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", "N"), _LETTERS, _BASES)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents spelled in sequence letters; lower case stays lower case."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", _spelled("text").alias("seq"), "lang")


def placed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with ``place``, the row and file that hold them, as ids may repeat or be missing, and with ``size``.

    The size needs no spelling: a letter without a base vanishes, any other is spelled as one.
    """
    place = F.concat_ws(" ", "_metadata.row_index", "_metadata.file_path")
    left = reduce(lambda text, letter: F.replace(text, F.lit(letter), F.lit("")), _LETTERS[len(_BASES) :], F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", place.alias("place"), F.length(left).cast("bigint").alias("size"), "text")
    return spread(docs).select("doc_id", "place", "size", _spelled("text").alias("seq"))


def motif_bins(spark: SparkSession, sf_dir: str, width: int = 250) -> DataFrame:
    """Line items as motif hits counted in bins."""
    start = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 13
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            _chrom("l_suppkey").alias("chrom"),
            (F.floor(start / width).cast("bigint") * width).alias("bin"),
            F.concat("l_returnflag", "l_linestatus").alias("motif"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )


def associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three associated regions per open urgent order, as list cells; other ROIs have none."""
    offsets = F.array(*[F.lit(d) for d in (-400, 300, 1500)])
    near = F.transform(offsets, lambda d: F.greatest(F.col("o_orderkey") * 100 + d, F.lit(0)))
    return (
        table(spark, sf_dir, "orders")
        .filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"))
        .select(
            _chrom("o_custkey").alias("chrom"),
            F.concat(F.lit("roi"), F.col("o_orderkey")).alias("name"),
            near.alias("starts"),
            F.transform(near, lambda x: x + 250).alias("ends"),
            F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)).alias("weights"),
        )
    )

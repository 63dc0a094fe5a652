"""Alignment chains: text lines to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import matches_from_start
from ..operators.scan import position_tile, prefix_scan
from .text import numbered_lines

_HEADER = [
    ("score", "bigint"), ("tchrom", "string"), ("tsize", "bigint"), ("tstrand", "string"), ("tstart", "bigint"), ("tend", "bigint"),
    ("qchrom", "string"), ("qsize", "bigint"), ("qstrand", "string"), ("qstart", "bigint"), ("qend", "bigint"), ("chain_id", "string"),
]


def chain_headers(lines: DataFrame) -> DataFrame:
    """Header lines as columns, keyed by their line number (``head``)."""
    tokens = F.split(F.trim("value"), r"\s+")
    fields = [F.element_at(tokens, i + 2).cast(kind).alias(name) for i, (name, kind) in enumerate(_HEADER)]
    return lines.filter(F.col("value").startswith("chain")).select(F.col("line_no").alias("head"), *fields)


def parse_chain_lines(
    lines: DataFrame,
    tselect: str | None = None,
    qselect: str | None = None,
    *,
    min_size: int = 0,
    min_score: int = 0,
    read_num: int = 0,
    with_line: bool = False,
) -> DataFrame:
    """Blocks of the chains in text lines ``line_no, value``.

    A line belongs to the last header before it, and a block starts where the sizes and gaps
    before it end: two prefix scans over line numbers, so a chain may span any number of tasks.
    ``read_num`` keeps the first chains that pass the filters, ``with_line`` the number of each block's line.
    """
    filled = lines.filter(F.trim("value") != "").select("line_no", "value")
    tile = position_tile(F.col("line_no"))
    is_head = F.col("value").startswith("chain")
    owned = prefix_scan(filled, [], "line_no", tile, {"head": ("max", F.when(is_head, F.col("line_no")))}, inclusive=True, blocks=True)
    tokens = F.split(F.trim("value"), r"\s+")

    def number(i: int) -> Column:
        return F.coalesce(F.try_element_at(tokens, F.lit(i)).cast("bigint"), F.lit(0))

    # headers are told by the scan, so that they are read from its shuffle and not from the text again
    data = owned.filter(F.col("head") < F.col("line_no")).select("head", "line_no", number(1).alias("size"), number(2).alias("dt"), number(3).alias("dq"))
    placed = prefix_scan(
        data,
        ["head"],
        "line_no",
        tile,
        {
            "t_before": ("sum", F.col("size") + F.col("dt")),
            "q_before": ("sum", F.col("size") + F.col("dq")),
            "n_before": ("sum", F.lit(1).cast("bigint")),
        },
    )
    heads = chain_headers(owned.filter(F.col("head") == F.col("line_no")))
    heads = heads.filter(F.assert_true(F.col("tstrand") == "+", F.lit("reverse target chain")).isNull())
    heads = heads.filter((F.col("score") >= min_score) & (F.col("tend") - F.col("tstart") >= min_size))
    if tselect:
        heads = heads.filter(matches_from_start(F.col("tchrom"), tselect))
    if qselect:
        heads = heads.filter(matches_from_start(F.col("qchrom"), qselect))
    if read_num > 0:
        heads = heads.orderBy("head").limit(read_num)
    t0, q_along = F.col("tstart") + F.col("t_before"), F.col("qstart") + F.col("q_before")
    # places of a minus strand count from its own start, so on the forward strand its blocks run downwards
    q0 = F.when(F.col("qstrand") == "-", F.col("qsize") - q_along - F.col("size")).otherwise(q_along)
    return placed.join(heads, "head").select(
        "tchrom",
        t0.alias("tstart"),
        (t0 + F.col("size")).alias("tend"),
        "tstrand",
        "qchrom",
        q0.alias("qstart"),
        (q0 + F.col("size")).alias("qend"),
        F.when(F.col("qstrand") == "-", -1).otherwise(1).alias("qstrand"),
        F.concat_ws(".", "chain_id", F.col("n_before") + 1).alias("blockid"),
        "score",
        *(["line_no"] if with_line else []),
    )


def check_chains(lines: DataFrame) -> DataFrame:
    """Chains whose blocks do not end where the header says: empty for sound files."""
    blocks = parse_chain_lines(lines).withColumn("chain_id", F.element_at(F.split("blockid", r"\."), 1))
    reach = F.when(F.col("qstrand") == -1, -F.col("qstart")).otherwise(F.col("qend"))
    ends = blocks.groupBy("chain_id").agg(F.max("tend").alias("t_last"), F.max(reach).alias("q_last"))
    heads = chain_headers(lines)
    expected_q = F.when(F.col("qstrand") == "-", F.col("qend") - F.col("qsize")).otherwise(F.col("qend"))
    return heads.join(ends, "chain_id").filter((F.col("t_last") != F.col("tend")) | (F.col("q_last") != expected_q))


def read_chain(spark: SparkSession, path: str, **filters) -> DataFrame:
    return parse_chain_lines(numbered_lines(spark, path), **filters)


def chrom_sizes_from_chain(lines: DataFrame, target: bool = True) -> DataFrame:
    """Chromosome sizes named by the headers (``chrom, size``)."""
    heads = chain_headers(lines)
    chrom, size = ("tchrom", "tsize") if target else ("qchrom", "qsize")
    return heads.groupBy(F.col(chrom).alias("chrom")).agg(F.min_by(size, "head").alias("size"))


def chain_index(lines: DataFrame) -> DataFrame:
    """Number and total target size of chains per chromosome pair, with both chromosome sizes."""
    return chain_headers(lines).groupBy("tchrom", "qchrom").agg(
        F.count(F.lit(1)).alias("n_chains"),
        F.sum(F.col("tend") - F.col("tstart")).alias("bp"),
        F.max("tsize").alias("tsize"),
        F.max("qsize").alias("qsize"),
    )

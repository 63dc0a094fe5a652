"""Quantile normalisation of samples x positions held as rows ``keys, sample, pos, value``.

A row may stand for ``w`` neighbouring positions that are equal in every sample, so run-length
signal is normalised without spelling out positions. Values are handled as integer thousandths, the precision of the method, so sums are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import position_tile, prefix_scan
from .values import rank_values

_VALUE_BITS = 16


def _thousandths(value: Column) -> Column:
    return F.round(F.bround(value.cast("double"), 3) * 1000).cast("bigint")


def densify(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All samples at each position whose values sum to more than zero; absent values become 0.

    The per-position list holds one entry per sample, i.e. per input file.
    """
    keys = list(keys)
    width = F.col("w") if "w" in df.columns else F.lit(1)
    cells = df.select(*keys, "sample", "pos", _thousandths(F.col("value")).alias("v"), width.cast("bigint").alias("w"))
    samples = cells.groupBy(*keys).agg(F.collect_set("sample").alias("_samples"))
    rows = (
        cells.groupBy(*keys, "pos")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("sample", "v"))).alias("_at"),
            F.sum("v").alias("_sum"),
            F.max("w").alias("w"),
        )
        .filter(F.col("_sum") > 0)
    )
    return rows.join(samples, keys).select(
        *keys, "pos", "w", F.size("_samples").alias("n_samples"), F.explode("_samples").alias("sample"), "_at"
    ).select(
        *keys, "sample", "pos", "w", "n_samples", F.coalesce(F.try_element_at("_at", F.col("sample")), F.lit(0)).alias("v")
    )


def _position_means(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over samples of the i-th smallest value, one row per run of equal means' start.

    A sample's sorted values are a step function of i. Summing the steps of all samples and
    scanning them gives the column sums without sorting any sample as a whole.
    """
    steps = runs.groupBy(*keys, "i").agg(F.sum("step").alias("step"), F.max("n_samples").alias("n_samples"))
    total = prefix_scan(steps, keys, "i", position_tile(F.col("i")), {"total": ("sum", F.col("step"))}, inclusive=True)
    return total.select(*keys, "i", F.bround(F.col("total") / F.col("n_samples"), 0).cast("bigint").alias("m"))


def nonzero_qnorm(df: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Quantile normalisation over the positions that carry signal, ties taking the lowest rank.

    Positions whose values sum to zero or less are not in the result: they stay zero.
    """
    keys = list(keys)
    width = ["w"] if "w" in df.columns else []
    dense = densify(df, keys)
    folded = dense.groupBy(*keys, "sample", "v").agg(F.sum("w").alias("n"), F.max("n_samples").alias("n_samples"))
    runs = prefix_scan(
        folded,
        [*keys, "sample"],
        "v",
        F.shiftright("v", _VALUE_BITS),
        {"below": ("sum", F.col("n")), "prev": ("max", F.col("v"))},
    ).select(
        *keys,
        "sample",
        "v",
        "n_samples",
        (F.col("below") + 1).alias("i"),
        (F.col("v") - F.coalesce("prev", F.lit(0))).alias("step"),
    )
    means = _position_means(runs, keys)
    levels = prefix_scan(
        means.groupBy(*keys, "m").agg(F.min("i").alias("first_i")),
        keys,
        "m",
        F.shiftright("m", _VALUE_BITS),
        {"next_m": ("min", F.col("m"))},
        reverse=True,
    )
    # a rank no mean starts at takes the middle of the means around it
    middle = F.bround((F.col("m") + F.coalesce("next_m", "m")) / 2, 0).cast("bigint")
    by_rank = means.join(levels, [*keys, "m"]).select(
        *keys, "i", F.when(F.col("i") == F.col("first_i"), F.col("m")).otherwise(middle).alias("new")
    )
    lookup = runs.select(*keys, "sample", "v", "i").join(by_rank, [*keys, "i"]).select(*keys, "sample", "v", "new")
    return dense.join(lookup, [*keys, "sample", "v"]).select(
        *keys, "sample", "pos", *width, (F.col("new") / 1000).alias("value")
    )


def _ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their place ``i`` in the order of the sample's values (ties by position) and their average rank."""
    group = [*keys, "sample"]
    ranks = rank_values(df, group, "value").select(*group, "value", "n_below", "avg_rank")
    within = prefix_scan(
        df.select(*group, "value", "pos"), [*group, "value"], "pos", position_tile(F.col("pos")),
        {"_same": ("sum", F.lit(1).cast("bigint"))},
    )
    return within.join(ranks, [*group, "value"]).select(
        *group, "pos", "value", (F.col("n_below") + F.col("_same") + 1).alias("i"), "avg_rank"
    )


def simple_qnorm(df: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Quantile normalisation that breaks ties by position instead of sharing a rank."""
    keys = list(keys)
    ordered = _ordered(df, keys)
    means = ordered.groupBy(*keys, "i").agg(F.avg("value").alias("mean"))
    return ordered.join(means, [*keys, "i"]).select(*keys, "sample", "pos", F.col("mean").alias("value"))


def preprocess_qnorm(df: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Quantile normalisation with average ranks for ties: between two places, the mean of both their means."""
    keys = list(keys)
    ordered = _ordered(df, keys)
    means = ordered.groupBy(*keys, "i").agg(F.avg("value").alias("mean"))
    low, high = means.select(*keys, F.col("i").alias("_lo"), F.col("mean").alias("_a")), means.select(*keys, F.col("i").alias("_hi"), F.col("mean").alias("_b"))
    placed = ordered.select(*keys, "sample", "pos", F.floor("avg_rank").cast("bigint").alias("_lo"), F.ceil("avg_rank").cast("bigint").alias("_hi"))
    return placed.join(low, [*keys, "_lo"]).join(high, [*keys, "_hi"]).select(*keys, "sample", "pos", ((F.col("_a") + F.col("_b")) / 2).alias("value"))

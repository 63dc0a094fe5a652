"""Exact order statistics over values: percentiles, medians, ranks, decile ranks.

Nothing here sorts a key in one task. Percentiles take two passes: a histogram over
value tiles finds the tiles that hold the wanted ranks (tiny shuffle, map-side combine),
then only those tiles are resolved value by value. Ranks fold equal values first and
scan the distinct ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import prefix_scan, with_axis

DECILES = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100]


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    fractions: Sequence[float],
    weight: Column | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles per key, in fraction order: ``n`` and array ``pct``.

    ``weight`` counts a row as that many equal observations. NULL values are skipped.
    """
    keys = list(keys)
    weight = F.lit(1) if weight is None else weight
    base = df.select(*keys, value.cast("double").alias("_v"), weight.cast("bigint").alias("_w"))
    base = base.filter(F.col("_v").isNotNull() & (F.col("_w") > 0))
    base = with_axis(base, "_v").withColumnRenamed("_axis", "_tile")

    along = Window.partitionBy(*keys)
    histogram = (
        base.groupBy(*keys, "_tile")
        .agg(F.sum("_w").alias("_n"))
        .withColumn("_end", F.sum("_n").over(along.orderBy("_tile").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("_n").over(along))
    )
    begin = F.col("_end") - F.col("_n")
    spots = F.array(*[F.lit(float(f)) for f in fractions])
    # the two neighbours of the interpolated rank f * (n - 1)
    wanted = F.array_distinct(
        F.flatten(
            F.transform(
                spots,
                lambda f: F.array(
                    F.floor(f * (F.col("n") - 1)).cast("bigint"), F.ceil(f * (F.col("n") - 1)).cast("bigint")
                ),
            )
        )
    )
    hit = histogram.select(
        *keys, "_tile", "n", begin.alias("_begin"), F.filter(wanted, lambda r: (r >= begin) & (r < F.col("_end"))).alias("_ranks")
    ).filter(F.size("_ranks") > 0)

    inner = Window.partitionBy(*keys, "_tile").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    resolved = (
        base.join(hit, [*keys, "_tile"])
        .groupBy(*keys, "_tile", "_v", "n", "_begin", "_ranks")
        .agg(F.sum("_w").alias("_w"))
        .withColumn("_to", F.col("_begin") + F.sum("_w").over(inner))
        .select(
            *keys,
            "n",
            "_v",
            F.explode(
                F.filter("_ranks", lambda r: (r < F.col("_to")) & (r >= F.col("_to") - F.col("_w")))
            ).alias("_rank"),
        )
    )
    # at most two rows per fraction and key are left
    by_rank = resolved.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def interpolate(f: Column) -> Column:
        where = f * (F.col("n") - 1)
        low, high = F.floor(where).cast("bigint"), F.ceil(where).cast("bigint")
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return a + (b - a) * (where - low)

    return by_rank.select(*keys, "n", F.transform(spots, interpolate).alias("pct"))


def rank_values(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """One row per distinct value of a key with ``n_below``, ``n_equal`` and the three rank forms.

    ``min_rank`` gives ties the lowest rank, ``avg_rank`` their mean, ``dense_rank`` counts
    distinct values. NULL has no rank; NaN ranks last.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull())
    folded = rows.groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n_equal"))
    scanned = prefix_scan(
        with_axis(folded, value, rows),
        keys,
        value,
        F.col("_axis"),
        {"n_below": ("sum", F.col("n_equal")), "_distinct": ("sum", F.lit(1).cast("bigint"))},
    )
    return scanned.select(
        *keys,
        value,
        "n_equal",
        "n_below",
        (F.col("n_below") + 1).alias("min_rank"),
        (F.col("n_below") + (F.col("n_equal") + 1) / F.lit(2.0)).alias("avg_rank"),
        (F.col("_distinct") + 1).alias("dense_rank"),
    )


def decile_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Add ``dec_rank``: 0 for zero, else 1 + the number of deciles of the non-zero values below the value."""
    keys = list(keys)
    edges = exact_percentiles(df.filter(F.col(value) != 0), keys, F.col(value), [d / 100 for d in DECILES], weight)
    above = F.aggregate(
        "pct", F.lit(1), lambda acc, edge: acc + F.when(F.col(value) > edge, F.lit(1)).otherwise(F.lit(0))
    )
    rank = F.when(F.col(value) == 0, F.lit(0)).otherwise(above)
    return df.join(edges.select(*keys, "pct"), keys, "left").select(*df.columns, rank.cast("int").alias("dec_rank"))


def clip_percentile(
    df: DataFrame, keys: Sequence[str], value: str, percent: float, weight: Column | None = None, zeros: DataFrame | None = None
) -> DataFrame:
    """Limit values to [0, percentile]. ``zeros`` (keys, ``n_zero``) adds positions that hold no row."""
    keys = list(keys)
    if percent >= 100:
        return df
    w = F.lit(1) if weight is None else weight
    seen = df.select(*keys, F.col(value).cast("double").alias("_x"), w.cast("bigint").alias("_n"))
    if zeros is not None:
        seen = seen.unionByName(zeros.select(*keys, F.lit(0.0).alias("_x"), F.col("n_zero").cast("bigint").alias("_n")))
    top = exact_percentiles(seen, keys, F.col("_x"), [percent / 100], F.col("_n"))
    clipped = F.least(F.greatest(F.col(value), F.lit(0.0)), F.element_at("pct", 1))
    kept = [c if c != value else clipped.alias(value) for c in df.columns]
    return df.join(top.select(*keys, "pct"), keys).select(*kept)


def top_percent(df: DataFrame, score: str, keep: float) -> DataFrame:
    """Rows whose score is not below the (100 - keep) percentile of the table."""
    if keep >= 100:
        return df
    tagged = df.withColumn("_all", F.lit(1))
    edge = exact_percentiles(tagged, ["_all"], F.col(score), [(100 - keep) / 100])
    floor = edge.select(F.element_at("pct", 1)).scalar()
    return df.filter(F.col(score) >= floor)


def bottom_k(df: DataFrame, keys: Sequence[str], digest: Column, rest: Sequence[Column], k: int | Column) -> DataFrame:
    """The ``k`` rows of each key that come first by ``digest`` (hex, evenly spread), then ``rest``.

    A histogram over the first four digits, combined before the shuffle, tells in which bucket the last wanted row
    lies; rows of later buckets are dropped where they are read, as these last buckets, one row per key, are broadcast.
    So about ``k`` rows of a key and one bucket's share are shuffled and sorted, however many it has.
    """
    keys = list(keys)
    rows = df.withColumn("_digest", digest).withColumn("_bucket", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    last = before.filter(F.col("_before") < k).groupBy(*keys).agg(F.max("_bucket").alias("_last"))
    near = rows.join(F.broadcast(last), keys).filter(F.col("_bucket") <= F.col("_last"))
    order = Window.partitionBy(*keys).orderBy("_digest", *rest)
    return near.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).select(*df.columns)


def sample_per_class(df: DataFrame, label: str, name: str, limit: int, seed: int = 0) -> DataFrame:
    """``min(limit, smallest class)`` rows of each class, chosen by a seeded hash of the name (MD5 of ``seed:name``)."""
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string")))
    return bottom_k(df.filter(F.col(name).isNotNull()), [label], digest, [F.col(name)], F.least(F.lit(limit), smallest))

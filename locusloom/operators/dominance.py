"""Sums over pairs of nested intervals without building the pairs.

An inner interval lies in an outer one if it starts no earlier and ends no later: dominance in two dimensions. It is
counted offline, bit by bit over the start: two different starts part at one bit, where the outer one has 0 and the
inner one 1 under the same higher bits. So at each bit and head every inner interval needs the weight of the outer
ones that end no earlier: a prefix scan over distinct ends. Equal starts are a level of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import position_tile, prefix_scan


def _shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _pow2(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)


def nested_points(
    rows: DataFrame, keys: Sequence[str], outer: Mapping[str, Column], inner: Mapping[str, Column], bounds: DataFrame | None = None
) -> DataFrame:
    """Distinct ends of each (keys, ``_bit``, ``_head``) with the sums of ``outer`` and ``inner`` amounts that meet there.

    An outer interval takes part at a bit only if it reaches into the upper half of its block there, an inner one
    only if it starts within the length of the longest interval in that half. So an interval of length L gives about log2(L)
    rows, whatever the depth; copies and equal ends are folded before the shuffle. ``bounds`` is a cheaper table with
    intervals at least as long and starts at least as large.
    """
    amounts = [*outer, *inner]
    taken = rows.select(*keys, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), *[c.cast("bigint").alias(n) for n, c in {**outer, **inner}.items()])
    is_outer, is_inner = (sum((F.col(n) for n in names), F.lit(0)) > 0 for names in (outer, inner))
    limits = (rows if bounds is None else bounds).agg(
        F.struct(
            F.floor(F.log2(F.greatest(F.max("start"), F.lit(1)))).cast("int").alias("top"),
            F.coalesce(F.max(F.col("end") - F.col("start")), F.lit(0)).cast("bigint").alias("longest"),
        ).alias("l")
    ).scalar()
    start, bit = F.col("start"), F.greatest(F.col("_bit"), F.lit(0))
    spread = taken.filter(is_outer | is_inner).select("*", F.explode(F.sequence(F.lit(-1), F.coalesce(limits["top"], F.lit(0)))).alias("_bit"))
    same = F.col("_bit") < 0
    upper = _shift(start, bit).bitwiseAND(F.lit(1)) == 1
    middle = (_shift(start, bit).bitwiseOR(F.lit(1))) * _pow2(bit)
    as_outer = is_outer & (same | (~upper & (F.col("end") > middle)))
    as_inner = is_inner & (same | (upper & (start.bitwiseAND(_pow2(bit) - 1) < limits["longest"])))
    head = F.when(same, start).otherwise(_shift(start, bit + 1))
    zero = F.lit(0).cast("bigint")
    return (
        spread.filter(as_outer | as_inner)
        .groupBy(*keys, "_bit", head.alias("_head"), "end")
        .agg(*[F.sum(F.when(as_outer if n in outer else as_inner, F.col(n)).otherwise(zero)).alias(n) for n in amounts])
    )


def nested_sums(
    rows: DataFrame,
    keys: Sequence[str],
    outer: Mapping[str, Column],
    inner: Mapping[str, Column],
    pairs: Sequence[tuple[str, str]],
    bounds: DataFrame | None = None,
) -> DataFrame:
    """``keys`` and, for each ``(outer name, inner name)`` of ``pairs``, the sum ``outer_inner`` of the products of both
    amounts over all pairs of rows where the inner interval lies in the outer one.

    Lines of partial sums: the caller adds them up by key. ``outer`` and ``inner`` map names to non-negative amounts;
    a row with amounts on both sides contains itself.
    """
    points = nested_points(rows, keys, outer, inner, bounds)
    spec = {f"_over_{n}": ("sum", F.col(n)) for n in outer}
    scanned = prefix_scan(points, [*keys, "_bit", "_head"], "end", position_tile(F.col("end")), spec, reverse=True, inclusive=True)
    some = sum((F.col(n) for n in inner), F.lit(0)) > 0
    return scanned.filter(some).select(*keys, *[(F.col(f"_over_{o}") * F.col(i)).alias(f"{o}_{i}") for o, i in pairs])

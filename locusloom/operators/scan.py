"""Ordered prefix aggregates that never gather one key in one task.

``Window.partitionBy(chrom).orderBy(start)`` sends a whole chromosome to a single
task. Here the order axis is cut into tiles: a window runs inside each tile, the tile
totals (one narrow row per tile) are scanned per key, and the carry is joined back on
(key, tile), the partitioning the rows already have. Where one key may hold the whole
table, tile totals are scanned in blocks, and block totals once.

Inputs hold at most one row per (key, order value), so a tile of ``2**bits`` integer
positions is bounded whatever the skew: duplicates are folded by a partial
aggregation before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TILE_BITS = 20
BLOCK_BITS = 10
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def position_tile(position: Column, bits: int = TILE_BITS) -> Column:
    """Tile of an integer coordinate."""
    return F.shiftright(position, bits)


def value_tile(value: Column, per_octave: int = 4096) -> Column:
    """Tile of a double: monotone in the value, with ``per_octave`` tiles per power of two.

    Infinities have a tile of their own at either end, NaN one above them, as in Spark's order.
    """
    v = value.cast("double")
    last = F.lit(1 << 40).cast("bigint")  # beyond the tile of any finite value
    # 1100 lifts the smallest subnormal exponent (-1074) above zero
    finite = F.when(F.abs(v) < F.lit(float("inf")), F.abs(v))
    magnitude = F.floor((F.log2(finite) + F.lit(1100.0)) * F.lit(float(per_octave))).cast("bigint") + 1
    return (
        F.when(v == 0, F.lit(0).cast("bigint"))
        .when(F.isnan(v), last + 1)
        .when(v > 0, F.coalesce(magnitude, last))
        .when(v < 0, -F.coalesce(magnitude, last))
    )


def with_axis(df: DataFrame, column: str, values: DataFrame | None = None, side: int = 32) -> DataFrame:
    """Add ``_axis``, a tile of ``column`` that follows the data: none holds much more than 1/``side ** 2`` of the rows.

    Boundaries are approximate quantiles over all rows of ``values`` (by default ``df``), whatever their key, from one
    aggregate with a sketch of bounded size. Those in one value tile divide it: ``_axis`` is the pair of the value tile and the
    number of boundaries in it up to the value, which grows with the value. The boundaries, at most ``side ** 2`` numbers, are
    broadcast; those of a tile are kept in rows of ``side``, so a value compares with few of them.
    """
    v = F.col(column).cast("double")
    finite = F.when(F.abs(v) < F.lit(float("inf")), v)
    cuts = F.expr(f"array({', '.join(f'{i / side**2}D' for i in range(side**2))})")
    sketch = (df if values is None else values).agg(F.percentile_approx(finite, cuts, 10 * side**2).alias("e"))
    edges = sketch.select(F.explode("e").alias("e")).groupBy(value_tile(F.col("e")).alias("_coarse")).agg(F.array_sort(F.collect_set("e")).alias("e"))
    heads = F.sequence(F.lit(1), F.size("e"), F.lit(side))
    square = edges.select("_coarse", F.transform(heads, lambda i: F.slice("e", i, F.lit(side))).alias("_edges"))
    # rows that begin at or below the value, then edges of the last of them
    row = F.size(F.filter("_edges", lambda r: F.element_at(r, 1) <= v))
    within = F.size(F.filter(F.element_at("_edges", F.greatest(row, F.lit(1))), lambda e: e <= v))
    place = F.when(F.col("_edges").isNotNull() & (row > 0), (row - 1) * side + within).otherwise(F.lit(0))
    met = df.withColumn("_coarse", value_tile(v)).join(F.broadcast(square), "_coarse", "left")
    return met.select(*df.columns, F.struct(F.col("_coarse").alias("tile"), place.alias("place")).alias("_axis"))


def also_reads(*columns: str) -> Column:
    """An aggregate that is never null, of columns a branch doesn't use.

    Spark prunes columns below a shuffle, branch by branch, and two branches with different columns can't read one shuffle:
    all that lies before it is then done twice. A filter on this keeps the columns alike.
    """
    return F.max(F.hash(*columns))


def prefix_scan(
    points: DataFrame,
    keys: Sequence[str],
    order: str,
    tile: Column,
    spec: Mapping[str, tuple[str, Column]],
    *,
    reverse: bool | Collection[str] = False,
    inclusive: bool = False,
    blocks: bool = False,
) -> DataFrame:
    """Add one column per ``spec`` entry: the fold over all rows of the key before this one.

    ``spec`` maps an output name to (``sum`` | ``max`` | ``min``, expression). ``reverse``
    scans from the largest order value down, all entries or those it names; ``inclusive`` adds the row itself. Sums
    over no rows are 0, other folds are NULL.

    Rows are dealt out by (keys, tile) once; windows and tile totals both read that shuffle, with all columns. ``blocks`` is for keys that
    may hold the whole table (or for no keys at all), with integer tiles: tile totals are then scanned in blocks of
    ``2 ** BLOCK_BITS`` tiles, and only block totals by key.
    """
    keys = list(keys)
    back = set(spec) if reverse is True else set(reverse or ())
    tiled = points.withColumn("_tile", tile).repartition(*keys, "_tile")
    folds = {n: f for n, (f, _) in spec.items()}
    hashed = [f.name for f in points.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash

    def before(by: Sequence[str], along: str, name: str, last: int) -> WindowSpec:
        return Window.partitionBy(*by).orderBy(F.desc(along) if name in back else F.asc(along)).rowsBetween(Window.unboundedPreceding, last)

    def carried(totals: DataFrame, by: Sequence[str], along: str, prefix: str) -> DataFrame:
        return totals.select(*by, along, *[_FOLD[f](f"_all_{n}").over(before(by, along, n, -1)).alias(f"{prefix}_{n}") for n, f in folds.items()])

    last = Window.currentRow if inclusive else -1
    rows = tiled.select("*", *[_FOLD[f](e).over(before([*keys, "_tile"], order, n, last)).alias(f"_in_{n}") for n, (f, e) in spec.items()])
    totals = tiled.groupBy(*keys, "_tile").agg(*[_FOLD[f](e).alias(f"_all_{n}") for n, (f, e) in spec.items()], also_reads(*hashed).alias("_read"))
    totals = totals.filter(F.col("_read").isNotNull()).drop("_read")
    if blocks:
        totals = totals.withColumn("_block", F.shiftright("_tile", BLOCK_BITS))
        parts = carried(totals, [*keys, "_block"], "_tile", "_near")
        whole = totals.groupBy(*keys, "_block").agg(*[_FOLD[f](f"_all_{n}").alias(f"_all_{n}") for n, f in folds.items()])
        both = parts.join(carried(whole, keys, "_block", "_far"), [*keys, "_block"], "left")
        carry = both.select(*keys, "_tile", *[_merged(f, F.col(f"_near_{n}"), F.col(f"_far_{n}")).alias(f"_carry_{n}") for n, f in folds.items()])
    else:
        carry = carried(totals, keys, "_tile", "_carry")
    out = [_merged(f, F.col(f"_in_{n}"), F.col(f"_carry_{n}")).alias(n) for n, f in folds.items()]
    kept = [c for c in points.columns if c not in spec]
    return rows.join(carry, [*keys, "_tile"], "left").select(*kept, *out)


def _merged(fold: str, a: Column, b: Column) -> Column:
    if fold == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if fold == "max" else F.least(a, b)

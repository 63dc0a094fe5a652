"""Interval relations: range joins, merging, gaps, coverage and overlap totals.

An interval table has ``chrom, start, end`` (half-open, 0-based, end > start) and any
other columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import TILE_BITS, also_reads, position_tile, prefix_scan

KEY = ["chrom"]
# cells of the join tree: 2**10 positions in a leaf, 16 cells in one of the next level, up to 2**42
LEAF_BITS, LEVEL_BITS, TOP_LEVEL = 10, 4, 8
POINTS_PER_CELL = 1024


# ---------------------------------------------------------------- predicates


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared positions of two intervals (negative when they are apart)."""
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def check_regions(df: DataFrame, sequence: str | None = None) -> DataFrame:
    """Fail the job on a region of length < 1, or on a sequence of another length."""
    message = F.concat_ws(" ", F.lit("malformed region:"), "chrom", "start", "end")
    ok = F.col("end") > F.col("start")
    if sequence:
        ok = ok & (F.length(sequence) == F.col("end") - F.col("start"))
    return df.filter(F.assert_true(ok, message).isNull())


# ---------------------------------------------------------------- range join


def _level_of(cells: Column) -> Column:
    """Level whose cells are at least as long as ``cells`` leaves."""
    level = F.lit(TOP_LEVEL)
    for i in reversed(range(TOP_LEVEL)):
        level = F.when(cells <= (1 << (LEVEL_BITS * i)), F.lit(i)).otherwise(level)
    return level


def _shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _levels(df: DataFrame, keys: Sequence[str]) -> tuple[Column, Column]:
    """Level of the longest interval, and the highest one whose cells would hold no more than ``POINTS_PER_CELL`` starts
    if these were spread evenly; from one small aggregate, as a scalar subquery."""
    length, start = F.col("end") - F.col("start"), F.col("start")
    found = df.agg(
        F.coalesce(F.max(length), F.lit(1)).cast("bigint").alias("len"),
        ((F.max(start) - F.min(start) + 1) * F.approx_count_distinct(F.struct(*keys)) / F.count(F.lit(1)) * POINTS_PER_CELL).alias("room"),
    )
    fits = F.lit(0)
    for i in range(1, TOP_LEVEL + 1):
        fits = F.when(F.col("room") >= float(1 << (LEAF_BITS + LEVEL_BITS * i)), F.lit(i)).otherwise(fits)
    levels = found.select(F.struct(_level_of(_shift(F.col("len"), F.lit(LEAF_BITS)) + 2).alias("longest"), fits.alias("fits"))).scalar()
    return levels["longest"], levels["fits"]


def _cells(df: DataFrame, start: Column, end: Column, extents: tuple[int, Column] | None = None, points: tuple[int, Column] | None = None) -> DataFrame:
    """Rows with ``_role, _level, _cell`` of their extents, their starts, or both, each given as a role and the top level.

    A start has one row per level: its leaf and the cells above it. An extent has one row per cell of the smallest set that covers
    it, leaves at its ends taken whole: on each level these are the cells before the first and after the last whole cell of the
    next level, at most 30; on the top level, or where no whole cell of the next level fits, all that are left. Both come from
    one pass, as a row that was costly to make or to fold would else be made in one task twice.
    """
    start, end = start.cast("bigint"), end.cast("bigint")
    first, last = _shift(start, F.lit(LEAF_BITS)), _shift(end - 1, F.lit(LEAF_BITS)) + 1
    given = [x for x in (extents, points) if x is not None]
    on_role = df.select("*", F.explode(F.array(*[F.lit(role) for role, _ in given])).alias("_role"))
    extent = F.lit(False) if extents is None else F.col("_role") == extents[0]
    own = F.lit(0) if extents is None else F.least(extents[1], _level_of(last - first))
    highest = own if points is None else F.when(extent, own).otherwise(points[1])
    on_level = on_role.select("*", F.explode(F.sequence(F.lit(0), highest)).alias("_level"))
    up = 1 << LEVEL_BITS
    ceiled = lambda x, bits: _shift(x + _pow2(bits) - 1, bits)
    bits = F.col("_level") * LEVEL_BITS
    low, high = ceiled(first, bits), _shift(last, bits)
    low_up, high_up = ceiled(first, bits + LEVEL_BITS) * up, _shift(last, bits + LEVEL_BITS) * up
    whole = (F.col("_level") == own) | (low_up >= high_up)
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    covering = F.when(whole, run(low, high)).otherwise(F.concat(run(low, low_up), run(high_up, high)))
    cells = F.when(extent, covering).otherwise(F.array(_shift(start, bits + LEAF_BITS)))
    return on_level.select("*", F.explode(cells).alias("_cell"))


def _point_cells(df: DataFrame, position: Column, top: Column) -> DataFrame:
    return _cells(df, position, position, points=(0, top)).drop("_role")


def _interval_cells(df: DataFrame, start: Column, end: Column, top: Column) -> DataFrame:
    return _cells(df, start, end, extents=(0, top)).drop("_role")


def _pow2(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)


def range_join(
    left: DataFrame,
    right: DataFrame,
    *,
    mode: str = "overlap",
    suffix: str = "_r",
    keys: Sequence[str] = ("chrom",),
    left_bound: DataFrame | None = None,
    right_bound: DataFrame | None = None,
) -> DataFrame:
    """Pairs of intervals that overlap, or where the right lies inside the left.

    Two intervals overlap if the right one starts within the left one, or the left one strictly within the right
    one: never both. So each interval stands for its start, one row per level of a tree of cells, and for its extent, cut into
    cells of that tree: an equi-join on (keys, role, level, cell). Above the leaves every pair that meets is a result;
    in a leaf, starts are compared. A short interval has a few rows; a long one is cut into cells that hold
    about ``POINTS_PER_CELL`` starts, so it meets those beneath it in many tasks. ``right``'s columns get ``suffix``.

    The levels in use are looked up in the inputs. For inputs that are costly to compute, a ``bound`` names a cheaper
    table whose longest interval is at least as long.
    """
    if mode not in ("overlap", "contained"):
        raise ValueError(f"unknown range join mode: {mode}")
    keys = list(keys)
    renamed = right.select(*[F.col(c).alias(c if c in keys else c + suffix) for c in right.columns])
    s, e, rs, re_ = F.col("start"), F.col("end"), F.col(f"start{suffix}"), F.col(f"end{suffix}")
    left_longest, left_fits = _levels(left if left_bound is None else left_bound, keys)
    right_longest, right_fits = _levels(right if right_bound is None else right_bound, keys)
    within, around = F.least(left_longest, right_fits), F.least(right_longest, left_fits)
    if mode == "overlap":
        a, b = _cells(left, s, e, (0, within), (1, around)), _cells(renamed, rs, re_, (1, around), (0, within))
        hit = F.when(F.col("_role") == 0, (rs >= s) & (rs < e)).otherwise((s > rs) & (s < re_))
    else:
        a, b = _cells(left, s, e, extents=(0, within)), _cells(renamed, rs, re_, points=(0, within))
        hit = (rs >= s) & (re_ <= e)
    # a broadcast would be decided by the size of the rows before they are cut into cells
    return a.join(b.hint("merge"), [*keys, "_role", "_level", "_cell"]).filter(hit).drop("_role", "_level", "_cell")


# ---------------------------------------------------------------- islands


def _placed(df: DataFrame, keys: list[str], bits: int, folds: dict[str, Column]) -> DataFrame:
    """Distinct starts with ``_island``, where their island begins, their farthest ``end`` and the ``folds`` of their rows.

    Equal starts are folded first, islands are built per tile, and only the tile totals are scanned along the key.
    Name no fold that isn't used: columns pruned in one branch would keep the two from reading one shuffle.
    """
    folded = df.groupBy(*keys, "start").agg(F.max("end").alias("end"), *[c.alias(n) for n, c in folds.items()])
    # the join below would leave NULLs out of one branch alone
    known = [F.col(c).isNotNull() for c in [*keys, "_tile"]]
    tiled = folded.withColumn("_tile", position_tile(F.col("start"), bits)).filter(reduce(and_, known))
    # islands inside each tile
    inside = Window.partitionBy(*keys, "_tile").orderBy("start")
    earlier, so_far = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        tiled.withColumn("_reach", F.max("end").over(earlier))
        .withColumn("_open", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), F.col("start")))
        .withColumn("_first", F.max("_open").over(so_far))
    )
    # an island that reaches past its tile absorbs the islands it meets in later tiles
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    read = also_reads(*folds) if folds else F.lit(0)
    tiles = (
        local.groupBy(*keys, "_tile")
        .agg(F.max("end").alias("_top"), F.max("_first").alias("_last"), read.alias("_read"))
        .filter(F.col("_read").isNotNull())
        .withColumn("_limit", F.max("_top").over(before))
        .withColumn("_open", F.when(F.col("_limit").isNull() | (F.col("_last") > F.col("_limit")), F.col("_last")))
        .select(*keys, "_tile", "_limit", F.max("_open").over(before).alias("_owner"))
    )
    begin = F.when(F.col("_first") <= F.col("_limit"), F.col("_owner")).otherwise(F.col("_first"))
    return local.join(tiles, [*keys, "_tile"]).select(*keys, "start", "end", *folds, begin.alias("_island"))


def islands(df: DataFrame, keys: Sequence[str] = ("chrom",), bits: int = TILE_BITS, **folds: Column) -> DataFrame:
    """Union of overlapping and book-ended intervals, with ``folds``, each a sum or a count, of the inputs of an island."""
    rows = _placed(df, list(keys), bits, folds)
    return rows.groupBy(*keys, F.col("_island").alias("start")).agg(F.max("end").alias("end"), *[F.sum(n).alias(n) for n in folds])


def merge_overlapping(df: DataFrame, keys: Sequence[str] = ("chrom",), bits: int = TILE_BITS, **sums: Column) -> DataFrame:
    """``islands`` with the number of inputs, ``n_merged``; extra keyword arguments are summed per island."""
    return islands(df, keys, bits, n_merged=F.count(F.lit(1)), **{n: F.sum(c) for n, c in sums.items()})


def island_members(df: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Every input row with the island it belongs to (``island_start``, ``island_end``)."""
    return _members(df, list(keys))


def _members(df: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """``island_members``; an island of more than ``most`` rows stops the job."""
    rows = _placed(df, keys, TILE_BITS, {} if most is None else {"n": F.count(F.lit(1))})
    # a start marks itself, and adds its end to the mark where its island begins
    counts = [] if most is None else ["n"]
    own = F.struct(F.col("_island").alias("start"), F.col("end").alias("island_end"), *counts)
    itself = F.struct("start", F.lit(None).cast("bigint").alias("island_end"), *[F.lit(0).cast("bigint").alias(n) for n in counts])
    told = F.when(F.col("_island") == F.col("start"), F.array(own)).otherwise(F.array(own, itself))
    marks = (
        rows.select(*keys, F.explode(told).alias("m"))
        .groupBy(*keys, F.col("m.start").alias("start"))
        .agg(F.max("m.island_end").alias("island_end"), *[F.sum(f"m.{n}").alias(n) for n in counts])
    )
    if most is not None:
        # told where rows look up their island, which is before any name is collected
        few = F.assert_true(F.col("n") <= most, F.lit("island has too many members to join their names"))
        marks = marks.filter(few.isNull()).drop("n")
    # island starts are input starts and islands are disjoint, so the last one at or before a row owns it
    owner = prefix_scan(
        marks,
        keys,
        "start",
        position_tile(F.col("start")),
        {
            "island_start": ("max", F.when(F.col("island_end").isNotNull(), F.col("start"))),
            "island_end": ("max", F.col("island_end")),
        },
        inclusive=True,
    )
    return df.join(owner, [*keys, "start"])


def merge_with_names(df: DataFrame, keys: Sequence[str] = ("chrom",), max_names: int = 100_000) -> DataFrame:
    """Islands named by their members' names joined with ``-`` in (start, end) order.

    The name is one cell, so an island of more than ``max_names`` members stops the job
    instead of building it; use ``island_members`` for such data.
    """
    keys = list(keys)
    members = _members(df.select(*keys, "start", "end", "name"), keys, max_names)
    return (
        members.groupBy(*keys, "island_start")
        .agg(
            F.max("end").alias("end"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("start", "end", "name"))), lambda m: m["name"]
                ),
                "-",
            ).alias("name"),
            F.count(F.lit(1)).alias("n_merged"),
        )
        .withColumnRenamed("island_start", "start")
        .select(*keys, "start", "end", "name", "n_merged")
    )


def consecutive_blocks(df: DataFrame, keys: Sequence[str] = ("chrom",), pos: str = "pos") -> DataFrame:
    """Runs of adjacent positions as half-open intervals."""
    unit = df.select(*keys, F.col(pos).alias("start"), (F.col(pos) + 1).alias("end")).distinct()
    return merge_overlapping(unit, keys).withColumnRenamed("n_merged", "n_positions")


def gaps(df: DataFrame, sizes: DataFrame, boundary: int = 0) -> DataFrame:
    """Complement of the intervals inside [boundary, size) of each chromosome of ``sizes``.

    The size travels in the scan, from the edge before the first interval, so no row is dealt out by chromosome alone.
    """
    none = F.lit(None).cast("bigint")
    edge = sizes.select("chrom", F.lit(-1).cast("bigint").alias("start"), F.lit(boundary).cast("bigint").alias("end"), F.col("size").cast("bigint").alias("_size"))
    tail = sizes.select("chrom", F.col("size").alias("start"), (F.col("size") + 1).alias("end"), none.alias("_size"))
    inner = df.select("chrom", "start", "end", none.alias("_size"))
    folded = inner.unionByName(edge).unionByName(tail).groupBy("chrom", "start").agg(F.max("end").alias("end"), F.max("_size").alias("_size"))
    reach = prefix_scan(folded, KEY, "start", position_tile(F.col("start")), {"_reach": ("max", F.col("end")), "_limit": ("max", F.col("_size"))})
    # without a limit the chromosome is not in sizes
    free = reach.filter(F.col("_limit").isNotNull() & (F.col("start") > F.col("_reach")))
    return free.select("chrom", F.col("_reach").alias("start"), F.least("start", "_limit").alias("end")).filter(F.col("end") > F.col("start"))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pieces covered by both tables; each table is disjoint within itself."""
    return range_join(left.select("chrom", "start", "end"), right.select("chrom", "start", "end")).select(
        "chrom", F.greatest("start", "start_r").alias("start"), F.least("end", "end_r").alias("end")
    )


def overlapping_rows(df: DataFrame) -> DataFrame:
    """Interval starts that begin before an earlier interval has ended: empty for disjoint data."""
    folded = df.groupBy("chrom", "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    reach = prefix_scan(folded, KEY, "start", position_tile(F.col("start")), {"_reach": ("max", F.col("end"))})
    return reach.filter((F.col("n") > 1) | (F.col("start") < F.col("_reach"))).select("chrom", "start", "end", "n")


def runs_and_select(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Alternating masked and conserved runs of each chromosome, from 0 to its size.

    ``conserved`` is the select bit of the run; run boundaries are the splits.
    """
    covered = islands(blocks).withColumn("conserved", F.lit(True))
    rest = gaps(blocks, sizes).withColumn("conserved", F.lit(False))
    return covered.unionByName(rest)


# ---------------------------------------------------------------- coverage without pairs


def coverage(df: DataFrame) -> DataFrame:
    """Number of regions and covered bases per chromosome (overlaps count twice)."""
    return df.groupBy("chrom").agg(
        F.count(F.lit(1)).alias("numreg"), F.sum(F.col("end") - F.col("start")).alias("covbp")
    )


def overlap_totals(regions: DataFrame, others: DataFrame, bits: int = TILE_BITS) -> DataFrame:
    """Add ``n_overlap`` and ``bp_overlap``: how many of ``others`` meet each region, and by how much.

    No pair is built. With S(x) starts and E(x) ends below x, the hits of a region are
    S(end) - E(start + 1), and its overlap is C(end) - C(start), where C(x) is the coverage
    summed up to x. All of them are prefix sums over distinct positions, so depth and skew
    do not change the cost.
    """
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    events = others.select(
        "chrom",
        F.explode(
            F.array(
                F.struct(F.col("start").alias("pos"), one.alias("s"), zero.alias("e"), zero.alias("probe")),
                F.struct(F.col("end").alias("pos"), zero.alias("s"), one.alias("e"), zero.alias("probe")),
            )
        ).alias("p"),
    ).select("chrom", "p.*")
    probes = regions.select("chrom", F.explode(F.array("start", "end")).alias("pos")).select(
        "chrom", "pos", zero.alias("s"), zero.alias("e"), one.alias("probe")
    )
    points = (
        events.unionByName(probes)
        .groupBy("chrom", "pos")
        .agg(F.sum("s").alias("s"), F.sum("e").alias("e"), F.max("probe").alias("probe"))
    )
    pos, tile = F.col("pos"), position_tile(F.col("pos"), bits)
    inner = pos - F.shiftleft(tile, bits)
    net = F.col("s") - F.col("e")
    scanned = prefix_scan(
        points,
        KEY,
        "pos",
        tile,
        {
            "n_start": ("sum", F.col("s")),
            "n_end": ("sum", F.col("e")),
            # sum of pos * net, split in tile and in-tile part to stay clear of overflow
            "net_tile": ("sum", net * tile),
            "net_inner": ("sum", net * inner),
        },
    ).filter(F.col("probe") == 1)
    depth = F.col("n_start") - F.col("n_end")
    covered = F.shiftleft(tile * depth - F.col("net_tile"), bits) + inner * depth - F.col("net_inner")
    profile = scanned.select(
        "chrom", "pos", F.col("n_start"), (F.col("n_end") + F.col("e")).alias("n_end"), covered.alias("covered")
    )
    at_start = profile.select(
        "chrom", F.col("pos").alias("start"), F.col("n_end").alias("_ended"), F.col("covered").alias("_c0")
    )
    at_end = profile.select(
        "chrom", F.col("pos").alias("end"), F.col("n_start").alias("_begun"), F.col("covered").alias("_c1")
    )
    return (
        regions.join(at_start, ["chrom", "start"])
        .join(at_end, ["chrom", "end"])
        .select(
            *regions.columns,
            (F.col("_begun") - F.col("_ended")).alias("n_overlap"),
            (F.col("_c1") - F.col("_c0")).alias("bp_overlap"),
        )
    )


def _reach_at(regions: DataFrame, others: DataFrame, *, strict: bool) -> DataFrame:
    """Farthest end among the others that start at (or strictly before) each region's start."""
    marks = (
        others.select("chrom", F.col("start").alias("pos"), F.col("end").alias("far"))
        .unionByName(regions.select("chrom", F.col("start").alias("pos"), F.lit(None).cast("bigint").alias("far")))
        .groupBy("chrom", "pos")
        .agg(F.max("far").alias("far"))
    )
    return prefix_scan(
        marks, KEY, "pos", position_tile(F.col("pos")), {"_far": ("max", F.col("far"))}, inclusive=not strict
    ).select("chrom", F.col("pos").alias("start"), "_far")


def inside_any(regions: DataFrame, others: DataFrame, *, strict_start: bool = False) -> DataFrame:
    """Add ``inside``: does some interval of ``others`` contain the region?"""
    far = _reach_at(regions, others, strict=strict_start)
    return regions.join(far, ["chrom", "start"], "left").select(
        *regions.columns, F.coalesce(F.col("_far") >= F.col("end"), F.lit(False)).alias("inside")
    )


def contains_any(regions: DataFrame, others: DataFrame, *, strict_start: bool = False) -> DataFrame:
    """Add ``contains``: does the region contain some interval of ``others``?"""
    marks = (
        others.select("chrom", F.col("start").alias("pos"), F.col("end").alias("near"))
        .unionByName(regions.select("chrom", F.col("start").alias("pos"), F.lit(None).cast("bigint").alias("near")))
        .groupBy("chrom", "pos")
        .agg(F.min("near").alias("near"))
    )
    near = prefix_scan(
        marks,
        KEY,
        "pos",
        position_tile(F.col("pos")),
        {"_near": ("min", F.col("near"))},
        reverse=True,
        inclusive=not strict_start,
    ).select("chrom", F.col("pos").alias("start"), "_near")
    return regions.join(near, ["chrom", "start"], "left").select(
        *regions.columns, F.coalesce(F.col("_near") <= F.col("end"), F.lit(False)).alias("contains")
    )


def restrict_to(regions: DataFrame, rois: DataFrame) -> DataFrame:
    """Distinct regions strictly after the start of, and ending within, some ROI."""
    return inside_any(regions, rois, strict_start=True).filter("inside").drop("inside").distinct()

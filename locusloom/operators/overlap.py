"""Pairwise statistics of region sets (the ``eval`` analysis)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals as iv
from ..session import cut_lineage
from .dominance import nested_sums
from .scan import TILE_BITS, position_tile, prefix_scan


_COUNTS = ("a_num", "a_cov", "a_hits", "b_num", "b_cov", "b_hits", "ovl_cov_bp", "roi_hits", "roi_miss")


def _stacked(sets: Sequence[DataFrame]) -> DataFrame:
    """All sets as one table, each row with the number of its set (``_set``)."""
    columns = ["chrom", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "name"]
    return reduce(DataFrame.unionByName, [d.select(F.lit(i).alias("_set"), *columns) for i, d in enumerate(sets)])


def _nearest_ends(rows: DataFrame, n: int, probes: DataFrame | None = None, *, strict: bool = False) -> DataFrame:
    """Per (chrom, start) and set ``i``: the farthest end of those that start no later (``far_i``), and the nearest end of
    those that start no earlier (``near_i``); ``strict`` leaves out equal starts. One scan for all sets and both ways."""
    mine = lambda i: F.when(F.col("_set") == i, F.col("end"))
    points = rows.select("_set", "chrom", "start", "end")
    if probes is not None:
        points = points.unionByName(probes.select(F.lit(-1).alias("_set"), "chrom", "start", "end"))
    folded = points.groupBy("chrom", "start").agg(*[f(mine(i)).alias(f"{kind}_{i}") for i in range(n) for kind, f in (("far", F.max), ("near", F.min))])
    spec = {f"far_{i}": ("max", F.col(f"far_{i}")) for i in range(n)} | {f"near_{i}": ("min", F.col(f"near_{i}")) for i in range(n)}
    return prefix_scan(folded, ["chrom"], "start", position_tile(F.col("start")), spec, reverse={f"near_{i}" for i in range(n)}, inclusive=not strict)


def _contained_flags(rows: DataFrame, n: int) -> DataFrame:
    """Rows with, for each set ``j``, ``hit_j``: contains one of a later set, or lies in one of an earlier set."""
    ends = _nearest_ends(rows, n)
    hits = [
        F.coalesce(F.when(F.col("_set") < j, F.col(f"near_{j}") <= F.col("end")).otherwise(F.col(f"far_{j}") >= F.col("end")), F.lit(False)).alias(f"hit_{j}")
        for j in range(n)
    ]
    return rows.join(ends, ["chrom", "start"]).select(*rows.columns, *hits)


def _overlap_flags(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows with, for each set ``j``, ``hit_j`` (shares a base with some interval of it); and per (chrom, pos) the bases
    shared by each pair of sets (``bp_i_j``) since the position before, to be added up.

    One scan over all starts and ends. A row meets a set if the farthest end of those that start before its end lies
    beyond its start. Bases of all pairs of intervals are depth times depth times length, so no row is asked for them.
    """
    edges = [F.struct(F.col("start").alias("pos"), F.lit(1).alias("open"), F.col("end").alias("far")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("open"), F.lit(None).cast("bigint").alias("far"))]
    ends = rows.select("_set", "chrom", F.explode(F.array(*edges)).alias("p"))
    mine = lambda i, value, other=None: F.when(F.col("_set") == i, value).otherwise(other)
    points = ends.groupBy("chrom", F.col("p.pos").alias("pos")).agg(
        *[F.sum(mine(i, F.col("p.open"), 0)).alias(f"net_{i}") for i in range(n)], *[F.max(mine(i, F.col("p.far"))).alias(f"end_{i}") for i in range(n)]
    )
    spec = {f"depth_{i}": ("sum", F.col(f"net_{i}")) for i in range(n)} | {f"far_{i}": ("max", F.col(f"end_{i}")) for i in range(n)} | {"last": ("max", F.col("pos"))}
    known = F.col("chrom").isNotNull() & F.col("pos").isNotNull()
    scanned = prefix_scan(points.filter(known), ["chrom"], "pos", position_tile(F.col("pos")), spec).filter(known)
    # one array per position, which isn't pruned, dealt out once: hits and bases are read from the same shuffle
    slots = [F.col("pos") - F.col("last"), *[F.col(f"depth_{i}") for i in range(n)], *[F.col(f"far_{i}") for i in range(n)]]
    profile = scanned.select("chrom", "pos", F.array(*slots).alias("_at")).repartition("chrom", "pos")
    at, depth, far = F.col("_at"), (lambda i: F.col("_at")[1 + i]), (lambda i: F.col("_at")[1 + n + i])
    met = rows.join(profile.withColumnRenamed("pos", "end"), ["chrom", "end"])
    flagged = met.select(*rows.columns, *[F.coalesce(far(j) > F.col("start"), F.lit(False)).alias(f"hit_{j}") for j in range(n)])
    shared = [F.coalesce(depth(i) * depth(j) * at[0], F.lit(0)).alias(f"bp_{i}_{j}") for i, j in combinations(range(n), 2)]
    return flagged, profile.select("chrom", "pos", *shared)


def _counts(**given: Column) -> list[Column]:
    return [given.get(c, F.lit(0)).cast("bigint").alias(c) for c in _COUNTS]


def _restricted(sets: Sequence[DataFrame], rois: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows of all sets strictly after the start of, and ending within, some ROI; and the ROIs with ``in_i``,
    whether they hold such a region of set ``i``. One scan of all rows; the ROIs are asked with those kept, which are stored
    as they are read several times."""
    n = len(sets)
    other = [[c for c in d.columns if c not in ("chrom", "start", "end", "name")] for d in sets]
    told = [d.withColumn("_rest", F.to_json(F.struct(*o)) if o else F.lit("")) for d, o in zip(sets, other, strict=True)]
    columns = ["chrom", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "name", "_rest"]
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(i).alias("_set"), *columns) for i, d in enumerate(told)])
    inside = cut_lineage(iv.inside_any(rows, rois, strict_start=True).filter("inside").drop("inside").distinct().drop("_rest"))
    ends = _nearest_ends(inside, n, rois, strict=True)
    holds = [F.coalesce(F.col(f"near_{i}") <= F.col("end"), F.lit(False)).alias(f"in_{i}") for i in range(n)]
    return inside, rois.select("chrom", "start", "end").join(ends, ["chrom", "start"]).select("chrom", *holds)


def pair_counts(sets: Sequence[DataFrame], rois: DataFrame | None = None, mode: str = "contained") -> DataFrame:
    """Lines of counts per chromosome and unordered pair of sets (``_a`` < ``_b``), to be added up.

    All pairs come from one sweep: each scan carries a slot for each set, and the rows of a set are joined to it
    once, whatever the number of sets. Copies and shared ends are folded before every scan; no pair of regions is built.
    """
    n = len(sets)
    if rois is None:
        rows, of_rois = _stacked(sets), None
    else:
        rows, of_rois = _restricted(sets, rois)
    if mode == "contained":
        flagged = cut_lineage(_contained_flags(rows, n))  # read by name and by position
    elif mode == "overlap":
        flagged, bases = _overlap_flags(rows, n)
    else:
        raise ValueError(f"unknown overlap mode: {mode}")
    per_name = flagged.groupBy("_set", "chrom", "name").agg(
        F.count(F.lit(1)).alias("num"),
        F.sum(F.col("end") - F.col("start")).alias("cov"),
        *[F.max(f"hit_{j}").cast("int").alias(f"hit_{j}") for j in range(n)],
    )
    others = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"hit_{j}").alias("hit")) for j in range(n)])
    paired = per_name.select("_set", "chrom", "num", "cov", F.explode(others).alias("o")).filter("_set != o.j")
    first = F.col("_set") < F.col("o.j")
    a, b = (lambda c: F.when(first, c).otherwise(0)), (lambda c: F.when(first, 0).otherwise(c))
    out = paired.select(
        F.least("_set", "o.j").alias("_a"),
        F.greatest("_set", "o.j").alias("_b"),
        "chrom",
        *_counts(
            a_num=a(F.col("num")), a_cov=a(F.col("cov")), a_hits=a(F.col("o.hit")), b_num=b(F.col("num")), b_cov=b(F.col("cov")), b_hits=b(F.col("o.hit")),
        ),
    )
    pairs = list(combinations(range(n), 2))

    def by_pair(df: DataFrame, value) -> DataFrame:
        """One line for each pair of a row: ``value(i, j)`` names its counts."""
        lines = F.array(*[F.struct(F.lit(i).alias("_a"), F.lit(j).alias("_b"), *_counts(**value(i, j))) for i, j in pairs])
        return df.select("chrom", F.explode(lines).alias("l")).select("l._a", "l._b", "chrom", *[f"l.{c}" for c in _COUNTS])

    if mode == "contained":
        # bases of later sets inside regions of earlier ones, once per containing region; regions without a hit have none
        some = lambda js: reduce(Column.__or__, [F.col(f"hit_{j}") for j in js])
        outer = {f"o{i}": F.when((F.col("_set") == i) & some(range(i + 1, n)), F.lit(1)).otherwise(0) for i in range(n - 1)}
        inner = {f"i{j}": F.when((F.col("_set") == j) & some(range(j)), F.col("end") - F.col("start")).otherwise(0) for j in range(1, n)}
        sums = nested_sums(flagged, ["chrom"], outer, inner, [(f"o{i}", f"i{j}") for i, j in pairs], rows)
        out = out.unionByName(by_pair(sums, lambda i, j: {"ovl_cov_bp": F.col(f"o{i}_i{j}")}))
    else:
        bases = bases.groupBy("chrom").agg(*[F.sum(f"bp_{i}_{j}").alias(f"bp_{i}_{j}") for i, j in pairs])
        out = out.unionByName(by_pair(bases, lambda i, j: {"ovl_cov_bp": F.col(f"bp_{i}_{j}")}))
    if of_rois is not None:
        hit = lambda i, j: F.col(f"in_{i}") | F.col(f"in_{j}")
        out = out.unionByName(by_pair(of_rois, lambda i, j: {"roi_hits": hit(i, j).cast("int"), "roi_miss": (~hit(i, j)).cast("int")}))
    return out


def pair_stats(a: DataFrame, b: DataFrame, rois: DataFrame | None = None, mode: str = "contained") -> DataFrame:
    """Per-chromosome statistics of A against B.

    ``contained``: a hit is a B region inside an A region. ``overlap``: any shared base.
    With ROIs both sides are first cut to the regions inside some ROI.
    """
    return pair_counts([a, b], rois, mode).groupBy("chrom").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def with_genome_row(stats: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Append the whole-genome row ``wg`` and derive misses, union and Jaccard after summing."""
    counts = [c for c in stats.columns if c not in ("chrom", *keys)]
    label = F.coalesce("chrom", F.lit("wg")).alias("chrom")
    rolled = stats.groupingSets(
        [[*map(F.col, keys), F.col("chrom")], [*map(F.col, keys)]], *keys, "chrom"
    ).agg(*[F.sum(c).alias(c) for c in counts])
    union = F.col("a_cov") + F.col("b_cov") - F.col("ovl_cov_bp")
    return rolled.select(
        *keys,
        label,
        *counts,
        (F.col("a_num") - F.col("a_hits")).alias("a_miss"),
        (F.col("b_num") - F.col("b_hits")).alias("b_miss"),
        union.alias("union_cov_bp"),
        F.when(union > 0, F.col("ovl_cov_bp") / union).alias("jaccard"),
    )


def pairwise_overlap(sets: dict[str, DataFrame], rois: DataFrame | None = None, mode: str = "contained") -> DataFrame:
    """Statistics of every unordered pair of labelled region sets, with whole-genome rows."""
    if len(sets) < 2:
        raise ValueError("at least two region sets are needed")
    stats = with_genome_row(pair_counts(list(sets.values()), rois, mode), ("_a", "_b"))
    label = F.array(*map(F.lit, sets))
    named = [F.element_at(label, F.col(c) + 1).alias(n) for c, n in (("_a", "label_a"), ("_b", "label_b"))]
    return stats.select(*named, *[c for c in stats.columns if c not in ("_a", "_b")])


def common_chroms(*tables: DataFrame) -> DataFrame:
    """Chromosomes present in all tables."""
    first, *rest = [t.select("chrom") for t in tables]
    for other in rest:
        first = first.intersect(other)
    return first.distinct()


def all_chroms(*tables: DataFrame) -> DataFrame:
    """Chromosomes present in any table."""
    first, *rest = [t.select("chrom") for t in tables]
    for other in rest:
        first = first.union(other)
    return first.distinct()

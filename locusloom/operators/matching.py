"""Background regions that resemble foreground regions in their sequence features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import intervals as iv
from .features import CHROMOSOME_BOUNDARY, attach_sequence, sequence_features
from .scan import position_tile, prefix_scan

GRID_DIMS = 3


def chebyshev(features: Sequence[str], left: str = "", right: str = "_t") -> Column:
    """Largest absolute difference over the features."""
    gaps = [F.abs(F.col(f + left) - F.col(f + right)) for f in features]
    return gaps[0] if len(gaps) == 1 else F.greatest(*gaps)


def within_radius(
    candidates: DataFrame, targets: DataFrame, features: Sequence[str], radius: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Pairs at most ``radius`` apart: candidate columns, ``target_id`` and ``dist``.

    Both sides are put on a grid of cells one radius wide over up to three features; a target
    goes to its own and the adjacent cells, so the join is an equi-join and misses nothing.
    """
    keys, dims = list(keys), list(features)[:GRID_DIMS]
    cell = [F.floor(F.col(f) / F.lit(float(radius))).cast("bigint") for f in dims]
    left = candidates.select("*", *[c.alias(f"_g{i}") for i, c in enumerate(cell)])
    right = targets.select(*keys, F.col("id").alias("target_id"), *[F.col(f).alias(f + "_t") for f in features])
    for i, f in enumerate(dims):
        own = F.floor(F.col(f + "_t") / F.lit(float(radius))).cast("bigint")
        right = right.select("*", F.explode(F.array(own - 1, own, own + 1)).alias(f"_g{i}"))
    grid = [f"_g{i}" for i in range(len(dims))]
    return (
        left.join(right, [*keys, *grid])
        .withColumn("dist", chebyshev(features))
        .filter(F.col("dist") <= radius)
        .select(*candidates.columns, "target_id", "dist")
    )


def nearest_within(
    candidates: DataFrame, targets: DataFrame, features: Sequence[str], radii: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Nearest target of each candidate up to the largest radius: ``id, target_id, dist``.

    Radii grow: whoever finds a target within a small radius has found the nearest one and
    leaves, so wide cells are only searched for candidates in sparse places. Equal feature
    vectors are looked up once; ties go to the smallest target id. Rounds are checkpointed,
    else each would compute all earlier ones again.
    """
    keys = list(keys)
    point = [*keys, *features]
    candidates = cut_lineage(candidates.select(*keys, "id", *features))
    unique = cut_lineage(targets.groupBy(*point).agg(F.min("id").alias("id")))
    open_points = candidates.select(*point).distinct()
    found = None
    for radius in sorted(radii):
        hits = cut_lineage(
            within_radius(open_points, unique, features, radius, keys)
            .groupBy(*point)
            .agg(F.min(F.struct("dist", "target_id")).alias("best"))
        )
        open_points = open_points.join(hits, point, "left_anti")
        found = hits if found is None else found.unionByName(hits)
    return candidates.join(found, point).select(*keys, "id", F.col("best.target_id").alias("target_id"), F.col("best.dist").alias("dist"))


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """One-to-one matching by ascending (dist, id, target_id) from pairs ``id, target_id, dist``.

    Each round keeps the pairs that are first both for their candidate and for their target;
    this yields the sequential greedy result. At least the first pair of all is settled per
    round, usually most of them. Rounds are checkpointed.
    """
    left = pairs.select("id", "target_id", "dist")
    chosen = left.limit(0)
    while True:
        best = F.struct("dist", "id", "target_id")
        by_id = left.groupBy("id").agg(F.min(best).alias("best")).select("best")
        by_target = left.groupBy("target_id").agg(F.min(best).alias("best")).select("best")
        now = cut_lineage(by_id.join(by_target, "best").select("best.id", "best.target_id", "best.dist"))
        if now.isEmpty():
            return chosen
        chosen = chosen.unionByName(now)
        left = cut_lineage(
            left.join(now.select("id"), "id", "left_anti").join(now.select("target_id"), "target_id", "left_anti")
        )


def complement_positions(free: DataFrame, wanted: DataFrame, seed: int, block: int = 4_096) -> DataFrame:
    """``n`` positions of each chromosome (``wanted``: ``chrom, n``), drawn with replacement from the pieces of ``free``.

    ``free`` holds disjoint ``chrom, start, end``. Each draw is a rank among the free positions, the first 15 hex digits of
    the MD5 of ``seed:chrom:k`` modulo their number; prefix sums of the pieces' lengths turn a piece into a range of
    ranks, and a range join finds the piece of a rank. Draws are numbered in blocks, so a chromosome's draws are
    spread over tasks. The ranges are checkpointed, as totals, the levels of the join and the join all read them. Returns
    ``chrom, k, pos, piece_start, piece_end``; chromosomes without free positions give none.
    """
    sized = free.withColumn("_len", F.col("end") - F.col("start"))
    ranked = prefix_scan(sized, ["chrom"], "start", position_tile(F.col("start")), {"_rank": ("sum", F.col("_len"))})
    ranges = cut_lineage(ranked.select("chrom", F.col("_rank").alias("start"), (F.col("_rank") + F.col("_len")).alias("end"), F.col("start").alias("piece_start"), F.col("end").alias("piece_end")))
    totals = ranges.groupBy("chrom").agg(F.max("end").alias("_total"))
    asked = wanted.filter("n > 0").join(totals, "chrom").select("chrom", "n", "_total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))).alias("_block"))
    first, last = F.col("_block") * block, F.least(F.col("n"), (F.col("_block") + 1) * block) - 1
    draws = asked.repartition("chrom", "_block").select("chrom", "_total", F.explode(F.sequence(first, last)).alias("k"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "chrom", "k"))
    rank = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.col("_total")
    points = draws.select("chrom", "k", rank.alias("start"), (rank + 1).alias("end"))
    met = iv.range_join(ranges, points, mode="contained")
    return met.select("chrom", F.col("k_r").alias("k"), (F.col("piece_start") + F.col("start_r") - F.col("start")).alias("pos"), "piece_start", "piece_end")


def draw_candidates(
    foreground: DataFrame, sizes: DataFrame, taken: DataFrame, wanted: DataFrame, length_limit: float, seed: int
) -> DataFrame:
    """Seeded random regions on free positions, 1.2 per region still wanted (``chrom, missing``).

    Half lengths lie in [min / 2 * (1 - limit %), max / 2) of the foreground of the chromosome. Centres are drawn from the
    positions that nothing taken covers; a region that leaves its free piece is dropped.
    """
    lengths = foreground.groupBy("chrom").agg(
        F.floor(F.min(F.col("end") - F.col("start")) * F.lit(1 - length_limit / 100) / 2).alias("lo"),
        F.floor(F.max(F.col("end") - F.col("start")) / 2).alias("hi"),
    )
    free = iv.gaps(taken, sizes)
    placed = complement_positions(free, wanted.select("chrom", F.ceil(F.col("missing") * 1.2).cast("bigint").alias("n")), seed)
    half = F.greatest(F.lit(1), F.col("lo") + F.pmod(F.xxhash64(F.lit(seed + 1), "chrom", "k"), F.greatest(F.lit(1), F.col("hi") - F.col("lo"))))
    drawn = placed.join(lengths, "chrom").select("chrom", (F.col("pos") - half).alias("start"), (F.col("pos") + half).alias("end"), "piece_start", "piece_end")
    return drawn.filter((F.col("start") >= F.col("piece_start")) & (F.col("end") <= F.col("piece_end"))).select("chrom", "start", "end").distinct()


def keep_disjoint(df: DataFrame) -> DataFrame:
    """Of overlapping candidates keep one per island: the first by (start, end)."""
    members = iv.island_members(df.select("chrom", "start", "end"))
    first = members.groupBy("chrom", "island_start").agg(F.min(F.struct("start", "end")).alias("one"))
    return first.select("chrom", "one.start", "one.end")


def match_background(
    foreground: DataFrame,
    sizes: DataFrame,
    chunks: DataFrame,
    features: Sequence[str],
    kmers: Sequence[int] = (),
    *,
    relax_init: float = 1.0,
    relax_step: float = 0.5,
    relax_limit: float = 3.0,
    max_rounds: int | None = None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Foreground with features, and one background region per foreground region where found.

    Each round draws candidates in free space, computes their features and accepts pairs within
    the current radius one-to-one. The radius grows by ``relax_step`` and starts again above
    ``relax_limit``. It goes on until every region has a partner or a whole cycle of radii finds none;
    ``max_rounds`` is a user's own limit. ``foreground`` needs ``chrom, start, end, index``; an empty one has an
    empty background.
    """
    if len(features) + len(kmers) > 10:
        raise ValueError("too many features for a nearest neighbour search")
    foreground = cut_lineage(foreground)
    longest = foreground.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    yardstick = int(longest * (1 + relax_limit / 100))
    fg = sequence_features(attach_sequence(foreground, chunks), features, kmers, yardstick)
    fg = cut_lineage(fg)
    names = sorted(c for c in fg.columns if c.startswith("ft"))
    index = F.concat_ws(":", "chrom", "index")
    targets = fg.select("chrom", index.alias("id"), *names)

    edge = sizes.select("chrom", F.lit(0).cast("bigint").alias("start"), F.least("size", F.lit(CHROMOSOME_BOUNDARY)).alias("end"))
    taken = fg.select("chrom", "start", "end").unionByName(edge.filter("end > start"))
    background, radius, turn, idle = None, relax_init, 0, 0
    cycle = 1 + max(0, int((relax_limit - relax_init) / relax_step)) if relax_step > 0 else 1
    while idle < cycle and (max_rounds is None or turn < max_rounds):
        open_targets = targets if background is None else targets.join(background.select(F.col("target_id").alias("id")), "id", "left_anti")
        wanted = open_targets.groupBy("chrom").agg(F.count(F.lit(1)).alias("missing"))
        if wanted.isEmpty():
            break
        drawn = cut_lineage(draw_candidates(fg, sizes, taken, wanted, relax_limit, seed + 2 * turn))
        drawn = cut_lineage(keep_disjoint(drawn))
        with_seq = attach_sequence(drawn, chunks).filter(
            F.length(F.regexp_replace("seq", "[^N]", "")) <= (F.col("end") - F.col("start")) * 0.05
        )
        cand = cut_lineage(
            sequence_features(with_seq, features, kmers, yardstick).withColumn("id", F.concat_ws(":", "chrom", "start", "end"))
        )
        pairs = cut_lineage(within_radius(cand.select("chrom", "id", *names), open_targets, names, radius, ["chrom"]))
        pairs = greedy_pairs(pairs)
        now = cut_lineage(cand.join(pairs, "id").select(*cand.columns, "target_id", "dist"))
        background = now if background is None else cut_lineage(background.unionByName(now))
        taken = cut_lineage(taken.unionByName(now.select("chrom", "start", "end")))
        radius = radius + relax_step if radius + relax_step <= relax_limit else relax_init
        turn, idle = turn + 1, idle + 1 if now.isEmpty() else 0
    if background is None:
        background = fg.limit(0).withColumn("target_id", F.lit(None).cast("string"))
    idx = F.element_at(F.split("target_id", ":"), -1).cast("bigint")
    named = background.select(
        "chrom", "start", "end", F.concat(F.lit("match_"), "chrom", F.lit("_idx"), idx).alias("name"), *names, "seq", idx.alias("index")
    )
    return fg, named

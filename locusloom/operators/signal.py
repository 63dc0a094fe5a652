"""Signal tracks as sparse runs ``chrom, start, end, value``; positions without a run are zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals as iv
from .scan import position_tile, prefix_scan
from .values import decile_ranks, exact_percentiles

SIGNAL_PREFIX = "ftmsig_"
LONG_REGION = 1 << 20


def overlay_last_wins(runs: DataFrame, order: str) -> DataFrame:
    """Disjoint runs from lines that may overlap: the line with the highest ``order`` wins.

    Lines are cut at every boundary inside them; each piece takes the value of its latest line.
    """
    cuts = runs.select("chrom", F.explode(F.array("start", "end")).alias("pos")).distinct()
    pieces = (
        prefix_scan(cuts, ["chrom"], "pos", position_tile(F.col("pos")), {"_next": ("min", F.col("pos"))}, reverse=True)
        .filter(F.col("_next").isNotNull())
        .select("chrom", F.col("pos").alias("start"), F.col("_next").alias("end"))
    )
    covered = iv.range_join(pieces, runs.select("chrom", "start", "end", "value", order))
    return covered.groupBy("chrom", "start", "end").agg(F.max_by("value_r", f"{order}_r").alias("value"))


def merge_samples(df: DataFrame, keys: Sequence[str], stat: str, n_samples: int) -> DataFrame:
    """Merge statistic of a value over the samples of each key; a sample without a row counts as zero."""
    v = F.col("value")
    short = F.count(F.lit(1)) < n_samples
    if stat == "mean":
        merged = F.sum(v) / F.lit(n_samples)
    elif stat == "max":
        merged = F.when(short, F.greatest(F.max(v), F.lit(0.0))).otherwise(F.max(v))
    elif stat == "min":
        merged = F.when(short, F.least(F.min(v), F.lit(0.0))).otherwise(F.min(v))
    elif stat == "median":
        # one value per input file, so the list is bounded by the number of files
        filled = F.array_sort(F.concat(F.collect_list(v), F.array_repeat(F.lit(0.0), F.lit(n_samples) - F.count(F.lit(1)).cast("int"))))
        a = F.element_at(filled, F.lit((n_samples + 1) // 2))
        b = F.element_at(filled, F.lit(n_samples // 2 + 1))
        merged = (a + b) / 2
    else:
        raise ValueError(f"unknown merge statistic: {stat}")
    return df.groupBy(*keys).agg(merged.alias("value"))


def axis_pieces(tracks: Mapping[str, DataFrame], masks: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Pieces of the axis between neighbouring boundaries: ``chrom, start, end``, one column per track and mask.

    A track column holds the value of the run over the piece or NULL; runs are disjoint within
    a track. A mask column tells whether any of its intervals, which may overlap, covers the
    piece. One prefix scan over all boundaries serves every column; pieces nothing covers are
    left out.
    """
    masks = masks or {}
    # numbers and no structs before the shuffle: those would be sorted to be folded, a whole split in one task
    none = F.lit(None)

    def bound(pos: str, upto: Column, v: Column, net: int) -> Column:
        return F.struct(F.col(pos).alias("pos"), upto.cast("bigint").alias("upto"), v.cast("double").alias("v"), F.lit(net).alias("net"))

    def points_of(table: DataFrame, which: int, opened: Column, closed: Column) -> DataFrame:
        return table.select("chrom", F.explode(F.array(opened, closed)).alias("p")).select("chrom", F.lit(which).alias("which"), "p.*")

    rows = [points_of(r, i, bound("start", F.col("end"), F.col("value"), 0), bound("end", none, none, 0)) for i, r in enumerate(tracks.values())]
    rows += [points_of(m, j, bound("start", none, none, 1), bound("end", none, none, -1)) for j, m in enumerate(masks.values(), start=len(tracks))]
    folds = []
    for i in range(len(tracks)):  # one run of a track at most starts at a position
        folds += [F.max(F.when(F.col("which") == i, F.col(c))).alias(f"_{c}{i}") for c in ("upto", "v")]
    net = [F.sum(F.when(F.col("which") == j, F.col("net"))).alias(f"_m{j}") for j in range(len(tracks), len(tracks) + len(masks))]
    folded = reduce(DataFrame.unionByName, rows).groupBy("chrom", "pos").agg(*folds, *net)
    begun = [
        F.when(F.col(f"_upto{i}").isNotNull(), F.struct(F.col("pos").alias("s"), F.col(f"_upto{i}").alias("e"), F.col(f"_v{i}").alias("v"))).alias(f"_r{i}")
        for i in range(len(tracks))
    ]
    points = folded.select("chrom", "pos", *begun, *[f"_m{j}" for j in range(len(tracks), len(tracks) + len(masks))])
    spec = {"_from": ("max", F.col("pos"))}
    spec |= {f"_last{i}": ("max", F.col(f"_r{i}")) for i in range(len(tracks))}
    spec |= {f"_depth{j}": ("sum", F.col(f"_m{j}")) for j in range(len(tracks), len(tracks) + len(masks))}
    scanned = prefix_scan(points, ["chrom"], "pos", position_tile(F.col("pos")), spec)
    values = [F.when(F.col(f"_last{i}.e") >= F.col("pos"), F.col(f"_last{i}.v")).alias(n) for i, n in enumerate(tracks)]
    flags = [(F.col(f"_depth{j}") > 0).alias(n) for j, n in enumerate(masks, start=len(tracks))]
    pieces = scanned.filter(F.col("_from").isNotNull()).select(
        "chrom", F.col("_from").alias("start"), F.col("pos").alias("end"), *values, *flags
    )
    covered = [F.col(n).isNotNull() for n in tracks] + [F.col(n) for n in masks]
    return pieces.filter(reduce(lambda a, b: a | b, covered))


def masked_track(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The track over conserved positions only, its zeros spelled out: ``chrom, start, end, value``."""
    pieces = axis_pieces({"v": runs}, {"cons": blocks})
    return pieces.filter("cons").select("chrom", "start", "end", F.coalesce("v", F.lit(0.0)).alias("value"))


def split_at_boundaries(runs: DataFrame, samples: Sequence | None = None) -> DataFrame:
    """Cut the runs of all samples at each other's boundaries: ``chrom, start, end, sample, value``.

    Every boundary becomes a point of every sample. One scan per sample then tells, for the
    piece that ends at a point, where it began and which run of the sample was opened last.
    Runs are disjoint within a sample; ``samples`` lists them where the caller knows them.
    """
    run = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("value").alias("v"))
    if samples is None:
        known = runs.groupBy("chrom").agg(F.collect_set("sample").alias("_samples"))
        spread = runs.join(known, "chrom")
    else:
        spread = runs.withColumn("_samples", F.array(*[F.lit(x) for x in samples]))
    ends = F.array(
        F.struct(F.col("start").alias("pos"), F.lit(True).alias("opens")), F.struct(F.col("end").alias("pos"), F.lit(False).alias("opens"))
    )
    points = (
        spread.select("chrom", "sample", run.alias("_run"), F.explode("_samples").alias("_other"), ends.alias("_ends"))
        .select("chrom", F.col("_other"), "sample", "_run", F.explode("_ends").alias("_end"))
        .groupBy("chrom", F.col("_other").alias("sample"), F.col("_end.pos").alias("pos"))
        .agg(F.max(F.when(F.col("_end.opens") & (F.col("_other") == F.col("sample")), F.col("_run"))).alias("_run"))
    )
    scanned = prefix_scan(
        points,
        ["chrom", "sample"],
        "pos",
        position_tile(F.col("pos")),
        {"_from": ("max", F.col("pos")), "_last": ("max", F.col("_run"))},
    )
    return scanned.filter(F.col("_last.e") >= F.col("pos")).select(
        "chrom", F.col("_from").alias("start"), F.col("pos").alias("end"), "sample", F.col("_last.v").alias("value")
    )


def signal_deciles(runs: DataFrame) -> DataFrame:
    """Decile rank of each run among the non-zero positions of its chromosome."""
    return decile_ranks(runs, ["chrom"], "value", F.col("end") - F.col("start"))


def bin_signal(
    runs: DataFrame, sizes: DataFrame, resolution: int, stat: str = "mean", skip_ends: int = 0
) -> DataFrame:
    """Signal summarised over bins of ``resolution`` positions (``chrom, start, end, value``).

    Bins run from ``skip_ends`` to ``size - skip_ends``; the last one may be shorter.
    """
    lo = F.lit(skip_ends).cast("bigint")
    hi = F.col("size") - skip_ends
    inside = (
        runs.join(sizes, "chrom")
        .select("chrom", F.greatest("start", lo).alias("start"), F.least("end", hi).alias("end"), "value", "size")
        .filter(F.col("end") > F.col("start"))
    )
    first = F.expr(f"(start - {skip_ends}) div {resolution}")
    last = F.expr(f"(end - 1 - {skip_ends}) div {resolution}")
    pieces = inside.select("*", F.explode(F.sequence(first, last)).alias("bin")).select(
        "chrom",
        "bin",
        (F.least(F.col("end"), (F.col("bin") + 1) * resolution + skip_ends) - F.greatest(F.col("start"), F.col("bin") * resolution + skip_ends)).alias("w"),
        "value",
        (F.least(hi, (F.col("bin") + 1) * resolution + skip_ends) - (F.col("bin") * resolution + skip_ends)).alias("len"),
    )
    keys = ["chrom", "bin"]
    v, w = F.col("value"), F.col("w")
    zeros = F.max("len") - F.sum("w")
    if stat == "median":
        # a bin holds at most ``resolution`` pieces
        rest = pieces.groupBy(*keys).agg(F.max("len").alias("len"), zeros.alias("w")).filter(F.col("w") > 0)
        full = pieces.unionByName(rest.select(*keys, "w", F.lit(0.0).alias("value"), "len"))
        out = full.groupBy(*keys).agg(F.max("len").alias("len"), F.percentile("value", 0.5, F.col("w")).alias("value"))
    else:
        log = F.sum(w * F.ln(F.abs(v)))
        sign = F.when(F.pmod(F.sum(F.when(v < 0, w).otherwise(F.lit(0))), F.lit(2)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
        folds = {
            "mean": F.sum(v * w) / F.max("len"),
            "sum": F.sum(v * w),
            "max": F.when(zeros > 0, F.greatest(F.max(v), F.lit(0.0))).otherwise(F.max(v)),
            "min": F.when(zeros > 0, F.least(F.min(v), F.lit(0.0))).otherwise(F.min(v)),
            "product": F.when((zeros > 0) | (F.min(F.abs(v)) == 0), F.lit(0.0)).otherwise(sign * F.exp(log)),
        }
        if stat not in folds:
            raise ValueError(f"unknown statistic: {stat}")
        out = pieces.groupBy(*keys).agg(F.max("len").alias("len"), folds[stat].alias("value"))
    begin = F.col("bin") * resolution + skip_ends
    return out.select("chrom", begin.alias("start"), (begin + F.col("len")).alias("end"), "value")


def masked_stats(regions: DataFrame, runs: DataFrame, blocks: DataFrame | None = None, label: str = "") -> DataFrame:
    """Signal features per distinct region: share conserved; mean, median, max, min over conserved positions.

    A region without conserved position gets zeros. ``blocks=None`` means that every position
    is conserved. Medians of regions up to ``LONG_REGION`` positions come from one aggregation,
    whose buffer that length bounds; longer ones, if any, take the two-pass percentile.
    """
    infix = f"{label}_" if label and not label.endswith("_") else label
    keys = ["chrom", "start", "end"]
    spans = regions.select(*keys).distinct()
    length = F.col("end") - F.col("start")
    track = masked_track(runs, regions.select(*keys) if blocks is None else blocks)
    pieces = iv.range_join(spans, track, left_bound=regions, right_bound=regions if blocks is None else blocks).select(
        *keys, F.col("value_r").alias("value"), iv.overlap_length(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r")).alias("w")
    )
    v, w = F.col("value"), F.col("w")
    short = F.when(length <= LONG_REGION, v)
    # the regions go along, so that those without a piece aren't looked up afterwards
    bare = regions.select(*keys, F.lit(None).cast(pieces.schema["value"].dataType).alias("value"), F.lit(0).cast(pieces.schema["w"].dataType).alias("w"))
    out = pieces.unionByName(bare).groupBy(*keys).agg(
        F.sum("w").alias("n_cons"),
        F.sum(v * w).alias("total"),
        F.max(v).alias("hi"),
        F.min(v).alias("lo"),
        F.percentile(short, 0.5, w).alias("mid"),
    )
    mid = F.col("mid")
    if not regions.filter(length > LONG_REGION).isEmpty():
        medians = exact_percentiles(pieces.filter(length > LONG_REGION), keys, v, [0.5], w)
        out = out.join(medians.select(*keys, "pct"), keys, "left")
        mid = F.coalesce("mid", F.element_at("pct", 1))
    p = SIGNAL_PREFIX + infix

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return out.select(
        *keys,
        or_zero(F.col("n_cons") / length * 100).alias(p + "pct_cons"),
        or_zero(F.col("total") / F.col("n_cons")).alias(p + "abs_mean"),
        or_zero(mid).alias(p + "abs_median"),
        or_zero(F.col("hi")).alias(p + "abs_max"),
        or_zero(F.col("lo")).alias(p + "abs_min"),
    )


def distribution_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample variance, biased skewness, Pearson kurtosis, minimum and maximum."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("ftdst_abs_mean"),
        F.var_samp(value).alias("ftdst_abs_var"),
        F.skewness(value).alias("ftdst_abs_skew"),
        (F.kurtosis(value) + 3).alias("ftdst_abs_kurt"),
        F.min(value).alias("ftdst_abs_min"),
        F.max(value).alias("ftdst_abs_max"),
    )


def smooth_signal(dense: DataFrame, resolution: int, boundary: int = 10_000) -> DataFrame:
    """Least-squares cubic spline per window of ten resolutions, floored at zero: ``chrom, pos, value``.

    Windows begin at ``boundary``, with a knot at every resolution; positions before it and an
    incomplete last window stay as they are. A group holds ``10 * resolution`` rows.
    """
    width = 10 * resolution

    def fit(pdf):
        import numpy as np

        if len(pdf) == width and pdf["_w"].iloc[0] >= 0:
            pdf = pdf.sort_values("pos")
            x = np.arange(width) / width
            knots = np.arange(1, 10) / 10
            basis = np.column_stack([x**k for k in range(4)] + [np.clip(x - t, 0, None) ** 3 for t in knots])
            weights, *_ = np.linalg.lstsq(basis, pdf["value"].to_numpy(), rcond=None)
            pdf = pdf.assign(value=basis @ weights)
        return pdf.assign(value=pdf["value"].clip(lower=0))[["chrom", "pos", "value"]]

    window = F.floor((F.col("pos") - boundary) / width).cast("bigint")
    return (
        dense.select("chrom", "pos", F.col("value").cast("double").alias("value"), window.alias("_w"))
        .groupBy("chrom", "_w")
        .applyInPandas(fit, "chrom string, pos bigint, value double")
    )


def map_signal(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lift signal runs over alignment blocks to query coordinates; strand -1 reverses a block.

    A run is cut where it leaves a block; its other columns go along.
    """
    carried = [c for c in runs.columns if c not in ("chrom", "start", "end")]
    hits = iv.range_join(
        runs,
        blocks.select(
            F.col("tchrom").alias("chrom"), F.col("tstart").alias("start"), F.col("tend").alias("end"),
            "qchrom", "qstart", "qend", "qstrand",
        ),
    )
    s, e = F.greatest("start", "start_r"), F.least("end", "end_r")
    plus = F.col("qstrand_r") == 1
    return hits.select(
        F.col("qchrom_r").alias("chrom"),
        F.when(plus, F.col("qstart_r") + s - F.col("start_r")).otherwise(F.col("qend_r") - (e - F.col("start_r"))).alias("start"),
        F.when(plus, F.col("qstart_r") + e - F.col("start_r")).otherwise(F.col("qend_r") - (s - F.col("start_r"))).alias("end"),
        *carried,
    )

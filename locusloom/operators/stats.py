"""Correlation of signal tracks and scores of predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals as iv
from .scan import position_tile, prefix_scan, with_axis
from .signal import axis_pieces
from .values import exact_percentiles, rank_values

# ---------------------------------------------------------------- correlation of columns


def weighted_pearson(df: DataFrame, keys: Sequence[str], a: str, b: str, weight: Column | None = None) -> DataFrame:
    """Pearson coefficient per key (``n``, ``stat``); a row counts ``weight`` times.

    Values are centred on the means of their key first, so large values that vary little keep their digits. Rows
    where a value is NULL, and NULL keys, are left out; without variance ``stat`` is NULL.
    """
    keys = list(keys)
    w = (F.lit(1) if weight is None else weight).cast("double")
    rows = df.select(*keys, F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y"), w.alias("_w"))
    rows = rows.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    by = keys or ["_k"]
    rows = rows if keys else rows.withColumn("_k", F.lit(1))
    w, x, y = F.col("_w"), F.col("_x"), F.col("_y")
    means = rows.groupBy(*by).agg((F.sum(w * x) / F.sum(w)).alias("_mx"), (F.sum(w * y) / F.sum(w)).alias("_my"))
    x, y = x - F.col("_mx"), y - F.col("_my")
    sums = rows.join(means, by).groupBy(*by).agg(
        F.sum(w).alias("n"),
        F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"),
        F.sum(w * x * y).alias("sxy"),
    )
    var_x, var_y = F.col("sxx"), F.col("syy")
    stat = F.when((var_x > 0) & (var_y > 0), F.col("sxy") / (F.sqrt(var_x) * F.sqrt(var_y)))
    return sums.select(*keys, F.col("n").cast("bigint").alias("n"), stat.alias("stat"))


def weighted_spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, weight: Column | None = None) -> DataFrame:
    """Pearson coefficient of the average ranks."""
    keys = list(keys)
    w = (F.lit(1) if weight is None else weight).cast("bigint")
    folded = df.select(*keys, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), w.alias("_w"))
    folded = folded.groupBy(*keys, "_a", "_b").agg(F.sum("_w").alias("_w"))
    rank_a = rank_values(folded, keys, "_a", F.col("_w")).select(*keys, "_a", F.col("avg_rank").alias("_ra"))
    rank_b = rank_values(folded, keys, "_b", F.col("_w")).select(*keys, "_b", F.col("avg_rank").alias("_rb"))
    ranked = folded.join(rank_a, [*keys, "_a"]).join(rank_b, [*keys, "_b"])
    return weighted_pearson(ranked, keys, "_ra", "_rb", F.col("_w"))


MEASURES = {"pearson": weighted_pearson, "spearman": weighted_spearman}


def kendall_tau(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Kendall's tau-b per key without building pairs.

    Concordant pairs are counted bit by bit: two dense ranks of ``a`` differ first at one bit,
    so at that bit each row with a 1 counts the rows with a 0, the same higher bits and a
    smaller ``b``. That is one prefix scan over (bit, higher bits) groups, n log n in total.
    """
    keys = list(keys)
    pairs = df.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    pairs = pairs.groupBy(*keys, "_a", "_b").agg(F.count(F.lit(1)).alias("c"))
    rank_a = rank_values(pairs, keys, "_a", F.col("c")).select(*keys, "_a", (F.col("dense_rank") - 1).alias("x"))
    rank_b = rank_values(pairs, keys, "_b", F.col("c")).select(*keys, "_b", F.col("dense_rank").alias("y"))
    ranked = pairs.join(rank_a, [*keys, "_a"]).join(rank_b, [*keys, "_b"]).select(*keys, "x", "y", "c")

    top_bit = rank_a.agg(F.coalesce(F.floor(F.log2(F.greatest(F.max("x"), F.lit(1)))), F.lit(0)).cast("int")).scalar()
    bits = ranked.select(*keys, "x", "y", "c", F.explode(F.sequence(F.lit(0), top_bit)).alias("bit"))
    one = F.call_function("shiftright", F.col("x"), F.col("bit")).bitwiseAND(F.lit(1)) == 1
    groups = bits.groupBy(*keys, "bit", F.call_function("shiftright", F.col("x"), F.col("bit") + 1).alias("head"), "y").agg(
        F.sum(F.when(one, 0).otherwise(F.col("c"))).alias("zeros"), F.sum(F.when(one, F.col("c")).otherwise(0)).alias("ones")
    )
    scanned = prefix_scan(groups, [*keys, "bit", "head"], "y", position_tile(F.col("y")), {"below": ("sum", F.col("zeros"))})
    big = "decimal(38,0)"
    concordant = scanned.groupBy(*keys).agg(F.sum(F.col("ones").cast("decimal(19,0)") * F.col("below").cast("decimal(19,0)")).cast(big).alias("p"))

    def tied(cols: list[str], name: str) -> DataFrame:
        c = F.col("_c").cast("decimal(19,0)")
        return (
            ranked.groupBy(*keys, *cols)
            .agg(F.sum("c").alias("_c"))
            .groupBy(*keys)
            .agg((F.sum(c * (c - 1)) / 2).cast("double").alias(name))
        )

    n = F.col("n").cast("double")
    counts = pairs.groupBy(*keys).agg(F.sum("c").alias("n"))
    tag = keys or ["_k"]
    parts = [counts, concordant, tied(["x"], "tx"), tied(["y"], "ty"), tied(["x", "y"], "txy")]
    if not keys:
        parts = [p.withColumn("_k", F.lit(1)) for p in parts]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, tag)
    total = n * (n - 1) / 2
    p = F.col("p").cast("double")
    q = total - F.col("tx") - F.col("ty") + F.col("txy") - p
    return joined.select(*keys, "n", ((p - q) / (F.sqrt(total - F.col("tx")) * F.sqrt(total - F.col("ty")))).alias("stat"))


# ---------------------------------------------------------------- correlation of tracks


def aligned_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spans where at least one of two sparse tracks has a run: ``chrom, start, end, a, b``."""
    pieces = axis_pieces({"a": a, "b": b})
    return pieces.select("chrom", "start", "end", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


PAIR = ("sample_a", "sample_b")


def _pairs_of(pieces: DataFrame, names: Sequence[str], columns: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """One row for each pair of ``names`` and row: ``sample_a, sample_b, kept..., a, b`` from the columns of the pair."""
    pairs = [
        F.struct(F.lit(names[i]).alias("sample_a"), F.lit(names[j]).alias("sample_b"), F.col(columns[i]).alias("a"), F.col(columns[j]).alias("b"))
        for i, j in combinations(range(len(names)), 2)
    ]
    if not pairs:
        raise ValueError("at least two tracks are needed")
    return pieces.select(*kept, F.explode(F.array(*pairs)).alias("p")).select(*[f"p.{c}" for c in PAIR], *kept, "p.a", "p.b")


def aligned_pairs(tracks: Mapping[str, DataFrame]) -> DataFrame:
    """``aligned_tracks`` of every pair of tracks, with both names as keys; the tracks are aligned once, all together."""
    columns = [f"_t{i}" for i in range(len(tracks))]
    pieces = axis_pieces(dict(zip(columns, tracks.values(), strict=True)))
    rows = _pairs_of(pieces, list(tracks), columns, ["chrom", "start", "end"]).filter("a IS NOT NULL OR b IS NOT NULL")
    return rows.fillna(0.0, ["a", "b"])


def corr_full(spans: DataFrame, sizes: DataFrame, measure: str = "pearson", keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Correlation over all positions of each chromosome, those without a run included as pairs of zeros."""
    keys = list(keys)
    w = spans.select(*keys, "a", "b", (F.col("end") - F.col("start")).alias("w"))
    used = w.groupBy(*keys).agg(F.sum("w").alias("used"))
    rest = used.join(sizes, "chrom").select(*keys, F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), (F.col("size") - F.col("used")).alias("w"))
    return MEASURES[measure](w.unionByName(rest.filter("w > 0")), keys, "a", "b", F.col("w"))


def corr_active(spans: DataFrame, measure: str = "pearson", keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Correlation over positions where at least one track is above zero."""
    active = spans.filter((F.col("a") > 0) | (F.col("b") > 0))
    return MEASURES[measure](active, keys, "a", "b", F.col("end") - F.col("start"))


def segment_means(
    a: DataFrame, b: DataFrame, blocks: DataFrame, rois: DataFrame | None = None, skip_size: int = 0
) -> DataFrame:
    """Mean of both tracks per conserved segment (touching blocks are one, cut to ROIs if given) of at least ``skip_size``."""
    return segment_pairs({"a": a, "b": b}, blocks, rois, skip_size).drop(*PAIR)


def _segment_table(tracks: Mapping[str, DataFrame], blocks: DataFrame, rois: DataFrame | None, skip_size: int) -> tuple[DataFrame, list[str]]:
    """Segments ``chrom, start, end, size`` with the mean of each track, and the names of these columns."""
    masks = {"cons": blocks} if rois is None else {"cons": blocks, "roi": rois}
    columns = [f"_t{i}" for i in range(len(tracks))]
    pieces = axis_pieces(dict(zip(columns, tracks.values(), strict=True)), masks)
    for name in masks:
        pieces = pieces.filter(name)
    size = F.col("end") - F.col("start")
    segments = iv.islands(pieces, **{c: F.sum(F.coalesce(c, F.lit(0.0)) * size) for c in columns}).withColumn("size", size)
    means = segments.filter(F.col("size") >= skip_size).select("chrom", "start", "end", "size", *[(F.col(c) / F.col("size")).alias(c) for c in columns])
    return means, columns


def segment_pairs(tracks: Mapping[str, DataFrame], blocks: DataFrame, rois: DataFrame | None = None, skip_size: int = 0) -> DataFrame:
    """``segment_means`` of every pair of tracks, with both names as keys; segments and sums are made once for all."""
    means, columns = _segment_table(tracks, blocks, rois, skip_size)
    return _pairs_of(means, list(tracks), columns, ["chrom", "start", "end", "size"])


def pair_summary(tracks: Mapping[str, DataFrame], blocks: DataFrame, rois: DataFrame | None = None, skip_size: int = 0) -> DataFrame:
    """``segment_summary`` of every pair of tracks and chromosome; a track is summed up once, not for each pair it is in."""
    means, columns = _segment_table(tracks, blocks, rois, skip_size)
    named = [x for c in columns for x in (F.lit(c), F.col(c))]
    keys, what = ["chrom", "what"], F.col("what")
    long = means.select("chrom", F.explode(F.create_map(F.lit("size"), F.col("size").cast("double"), *named)).alias("what", "x"))
    folded = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    medians = exact_percentiles(long, keys, F.col("x"), [0.5]).select(*keys, F.element_at("pct", 1).alias("mid"))
    wide = folded.join(medians, keys).groupBy("chrom").agg(
        F.max(F.when(what == "size", F.col("n"))).alias("num_regions"),
        *[F.max(F.when(what == c, F.struct("lo", "mid", "hi"))).alias(c) for c in ("size", *columns)],
    )
    pairs = _pairs_of(wide, list(tracks), columns, ["chrom", "num_regions", "size"])

    def of(column: str, stat: str, name: str) -> Column:
        value = F.col(f"{column}.{stat}")
        return (value.cast("bigint") if column == "size" else F.round(value, 2)).alias(name)

    return pairs.select(
        *PAIR, "chrom", "num_regions",
        of("size", "lo", "reg_size_min"), of("size", "hi", "reg_size_max"),
        of("a", "lo", "sig1_mean_min"), of("a", "hi", "sig1_mean_max"),
        of("b", "lo", "sig2_mean_min"), of("b", "hi", "sig2_mean_max"),
        of("size", "mid", "reg_size_median"), of("a", "mid", "sig1_mean_median"), of("b", "mid", "sig2_mean_median"),
    )


def segment_summary(segments: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Number of segments, and median, minimum and maximum of their size and of both means."""
    keys = list(keys)
    folded = segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_regions"),
        F.min("size").alias("reg_size_min"),
        F.max("size").alias("reg_size_max"),
        F.round(F.min("a"), 2).alias("sig1_mean_min"),
        F.round(F.max("a"), 2).alias("sig1_mean_max"),
        F.round(F.min("b"), 2).alias("sig2_mean_min"),
        F.round(F.max("b"), 2).alias("sig2_mean_max"),
    )
    long = segments.select(
        *keys,
        F.explode(F.create_map(F.lit("reg_size"), F.col("size").cast("double"), F.lit("sig1_mean"), F.col("a"), F.lit("sig2_mean"), F.col("b"))).alias("what", "x"),
    )
    medians = exact_percentiles(long, [*keys, "what"], F.col("x"), [0.5])

    def median(what: str) -> Column:
        return F.max(F.when(F.col("what") == what, F.element_at("pct", 1)))

    picked = medians.groupBy(*keys).agg(
        median("reg_size").cast("bigint").alias("reg_size_median"),
        F.round(median("sig1_mean"), 2).alias("sig1_mean_median"),
        F.round(median("sig2_mean"), 2).alias("sig2_mean_median"),
    )
    return folded.join(picked, keys)


# ---------------------------------------------------------------- scores of predictions


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def confusion(df: DataFrame, truth: str, pred: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.sum(_weight(weight)).alias("n"))


def f1_macro(df: DataFrame, truth: str, pred: str, weight: str | None = None) -> DataFrame:
    """Unweighted mean over classes of the F1 score."""
    cells = confusion(df, truth, pred, weight)
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0.0))
    rows = cells.select(F.col("truth").alias("cls"), hit.alias("tp"), F.col("n").alias("half")).unionByName(
        cells.select(F.col("pred").alias("cls"), F.lit(0.0).alias("tp"), F.col("n").alias("half"))
    )
    per_class = rows.groupBy("cls").agg((2 * F.sum("tp") / F.sum("half")).alias("f1"))
    return per_class.agg(F.avg("f1").alias("score"))


def accuracy(df: DataFrame, truth: str, pred: str, weight: str | None = None) -> DataFrame:
    w = _weight(weight)
    return df.agg((F.sum(F.when(F.col(truth) == F.col(pred), w).otherwise(F.lit(0.0))) / F.sum(w)).alias("score"))


def roc_auc(df: DataFrame, truth: str, score: str, weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve for a 0/1 truth; equal scores share their mean rank."""
    keys = list(keys) or ["_k"]
    tagged = df if keys != ["_k"] else df.withColumn("_k", F.lit(1))
    w = _weight(weight)
    folded = tagged.groupBy(*keys, F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(truth) == 1, w).otherwise(F.lit(0.0))).alias("pos"),
        F.sum(F.when(F.col(truth) == 1, F.lit(0.0)).otherwise(w)).alias("neg"),
    )
    tiled = with_axis(folded, "s", tagged.select(F.col(score).cast("double").alias("s")))
    scanned = prefix_scan(tiled, keys, "s", F.col("_axis"), {"below": ("sum", F.col("neg"))})
    area = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))
    out = scanned.groupBy(*keys).agg(area.alias("score"))
    return out.drop("_k")


def mean_squared_error(df: DataFrame, truth: str, pred: str, weight: str | None = None) -> DataFrame:
    w = _weight(weight)
    d = F.col(truth) - F.col(pred)
    return df.agg((F.sum(w * d * d) / F.sum(w)).alias("score"))


def r2(df: DataFrame, truth: str, pred: str, weight: str | None = None) -> DataFrame:
    """Coefficient of determination; the truth is centred on its weighted mean first."""
    w, y = _weight(weight), F.col(truth).cast("double")
    d = y - F.col(pred)
    off = y - df.agg(F.sum(w * y) / F.sum(w)).scalar()
    return df.agg((1 - F.sum(w * d * d) / F.sum(w * off * off)).alias("score"))


def permutation_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Statistics over the scores of permuted targets (one row per permutation)."""
    return scores.agg(
        F.avg(score).alias("perm_mean"),
        F.percentile(score, 0.5).alias("perm_median"),
        F.min(score).alias("perm_min"),
        F.stddev_pop(score).alias("perm_std"),
        F.var_pop(score).alias("perm_var"),
        F.max(score).alias("perm_max"),
        F.percentile(score, 0.95).alias("perm_95pct"),
        F.percentile(score, 0.05).alias("perm_5pct"),
    )

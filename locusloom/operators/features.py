"""Region features: windows, attached sequence, regions of interest, motifs, associated regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import dnase_motif, kmer_table, sequence_columns
from . import intervals as iv
from .signal import masked_stats

# Fixed value: bases skipped at the start of each chromosome.
CHROMOSOME_BOUNDARY = 10_000
SEQ_CHUNK = 65536
REGION = ["chrom", "start", "end"]


# ---------------------------------------------------------------- windows


def sliding_windows(df: DataFrame, window: int, step: int) -> DataFrame:
    """Windows of fixed size inside each region; a region that fits none stays whole.

    Windows begin at the region start, every ``step`` positions, below the last multiple of
    the window size that is not past the region end. ``source`` is the region's name.
    """
    if step <= 0 or window < step:
        raise ValueError(f"window {window} must be at least the step size {step}, and the step positive")
    limit = F.least(F.col("end") - window, F.floor(F.col("end") / window) * window - 1).cast("bigint")
    starts = F.when(limit >= F.col("start"), F.sequence(F.col("start"), limit, F.lit(step).cast("bigint")))
    return df.select("chrom", F.col("name").alias("source"), "start", "end", F.explode_outer(starts).alias("_at")).select(
        "chrom",
        "source",
        F.coalesce("_at", "start").alias("start"),
        F.coalesce(F.col("_at") + window, F.col("end")).alias("end"),
    )


def training_positions(sizes: DataFrame, num_samples: int, resolution: int, boundary: int = CHROMOSOME_BOUNDARY, seed: int = 0) -> DataFrame:
    """Five windows around each of ``num_samples`` seeded positions, shared out over the chromosomes."""
    n_chroms = max(1, sizes.count())
    per_chrom, rest = divmod(num_samples, n_chroms)
    ranked = sizes.select("chrom", "size", (F.row_number().over(_by_chrom()) - 1).cast("bigint").alias("_rank"))
    # the first ``rest`` chromosomes get one more; samples are numbered over all tasks, not per chromosome
    g, larger = F.col("id"), rest * (per_chrom + 1)
    small = max(1, per_chrom)
    rank = F.when(g < larger, F.floor(g / (per_chrom + 1))).otherwise(rest + F.floor((g - larger) / small)).cast("bigint")
    number = F.when(g < larger, g % (per_chrom + 1)).otherwise((g - larger) % small)
    drawn = sizes.sparkSession.range(num_samples).select(rank.alias("_rank"), number.alias("sample_n")).join(ranked, "_rank")
    span = F.greatest(F.col("size") - 2 * boundary, F.lit(1))
    pos = F.lit(boundary) + F.pmod(F.xxhash64(F.lit(seed), "chrom", "sample_n"), span)
    offsets = F.array(*[F.lit(k * resolution) for k in (-4, -2, 0, 2, 4)])
    return drawn.select("chrom", "sample_n", pos.alias("_pos"), F.explode(offsets).alias("_move")).select(
        "chrom", "sample_n", (F.col("_pos") + F.col("_move")).alias("start"), (F.col("_pos") + F.col("_move") + resolution).alias("end")
    )


def estimate_windows(sizes: DataFrame, resolution: int, boundary: int = CHROMOSOME_BOUNDARY) -> DataFrame:
    """Adjacent windows from ``boundary`` to the last full one: the rows a signal estimate predicts."""
    last = F.floor(F.col("size") / resolution) * resolution - resolution
    starts = F.sequence(F.lit(boundary).cast("bigint"), last.cast("bigint"), F.lit(resolution).cast("bigint"))
    return sizes.filter(last >= boundary).select("chrom", F.explode(starts).alias("start")).select(
        "chrom", "start", (F.col("start") + resolution).alias("end")
    )


def _by_chrom():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("chrom")


# ---------------------------------------------------------------- sequence


def _cut(letters: Column, octets: Column, one_byte: Column, at: Column, n: Column) -> Column:
    """``n`` letters from the position ``at`` on, the first being 1.

    Finding a position in a string walks over the letters before it; where all are ``one_byte`` long it is that of the octet.
    """
    return F.when(one_byte, F.substr(octets, at, n).cast("string")).otherwise(F.substr(letters, at, n))


def _one_byte(letters: Column) -> Column:
    return F.octet_length(letters) == F.length(letters)


def chunk_sequences(df: DataFrame, chunk: int = SEQ_CHUNK) -> DataFrame:
    """Whole sequences (``chrom, seq``) as chunks ``chrom, chunk, seq``: the form joins use."""
    seq = F.col("seq")
    known = df.select("chrom", "seq", seq.cast("binary").alias("_octets"), _one_byte(seq).alias("_one_byte"))
    piece = _cut(seq, F.col("_octets"), F.col("_one_byte"), F.col("chunk") * chunk + 1, F.lit(chunk))
    return known.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / chunk).cast("int"))).alias("chunk")).select(
        "chrom", F.col("chunk").cast("bigint").alias("chunk"), piece.alias("seq")
    )


def attach_sequence(regions: DataFrame, chunks: DataFrame, chunk: int = SEQ_CHUNK) -> DataFrame:
    """Add ``seq``, the sequence under each region, from chunked sequences.

    Regions meet the chunks they touch by an equi-join on (chrom, chunk). A region inside one chunk is cut from it there;
    only the pieces of those that touch several are dealt out again and put together. A region past the end of its sequence
    fails the job, as does one on a chunk stored twice.
    """
    own = [F.col(f"`{c}`") for c in (*REGION, *[c for c in regions.columns if c not in (*REGION, "seq")])]
    known = regions.select(*own).filter(F.col("chrom").isNotNull())
    first, last = F.expr(f"start div {chunk}"), F.expr(f"(end - 1) div {chunk}")
    lettered = F.count(F.when(F.octet_length("seq") > 0, 1))
    # dealt out before they are folded, which leaves them as the join needs them: one shuffle, one sort
    stored = (
        chunks.select("chrom", F.col("chunk").alias("_chunk"), "seq")
        .repartition("chrom", "_chunk")
        .groupBy("chrom", "_chunk")
        .agg(F.when(lettered <= 1, F.max("seq")).alias("_letters"))
        .withColumn("_one_byte", _one_byte(F.col("_letters")))
    )
    base = F.col("_chunk") * chunk
    cut_from = F.greatest(F.col("start") - base, F.lit(0))
    cut_to = F.least(F.col("end") - base, F.lit(chunk))
    letters, at, n = F.col("_letters"), (cut_from + 1).cast("int"), (cut_to - cut_from).cast("int")
    piece = _cut(letters, letters.cast("binary"), F.col("_one_byte"), at, n)
    met = lambda df: df.join(stored, ["chrom", "_chunk"], "left")
    inside = met(known.filter(first == last).withColumn("_chunk", first)).select(*own, piece.alias("seq"))
    numbered = known.filter(first != last).withColumn("_row", F.monotonically_increasing_id())
    pieces = met(numbered.withColumn("_chunk", F.explode(F.sequence(first, last))))
    across = (
        pieces.select("_row", F.struct(*own).alias("_own"), F.struct("_chunk", piece.alias("seq")).alias("_piece"))
        .groupBy("_row")
        .agg(F.first("_own").alias("_own"), F.array_sort(F.collect_list("_piece")).alias("_pieces"))
        .select("_own.*", F.array_join(F.transform("_pieces", lambda p: p["seq"]), "").alias("seq"))
    )
    return iv.check_regions(inside.unionByName(across), "seq")


def sequence_features(
    df: DataFrame, classes: Sequence[str], kmers: Sequence[int] = (), yardstick: int = 0, ids: Sequence[str] = REGION
) -> DataFrame:
    """Add the requested sequence feature classes; row expressions first, word counts by join."""
    if "kmf" in classes and not kmers:
        raise ValueError("no values for k-mer frequency given")
    out = df.select("*", *sequence_columns(classes, yardstick))
    ids = list(ids)
    distinct = df.select(*ids, "seq").dropDuplicates(ids)
    if "kmf" in classes:
        for k in kmers:
            out = out.join(kmer_table(distinct, ids, k), ids)
    if "dnm" in classes:
        out = out.join(dnase_motif(distinct, ids), ids)
    return out


# ---------------------------------------------------------------- regions of interest


def roi_features(regions: DataFrame, rois: DataFrame, label: str = "", quantify: Sequence[str] = ("all",)) -> DataFrame:
    """Add whether, how often and over how much of its length a region meets ROIs."""
    infix = f"{label}_" if label and not label.endswith("_") else label
    totals = iv.overlap_totals(regions, rois)
    wanted = set(quantify)
    out: list[Column] = []
    if wanted & {"binary", "all"}:
        out.append((F.col("n_overlap") > 0).cast("int").alias(f"ftroi_{infix}bin_obs"))
    if wanted & {"counts", "all"}:
        out.append(F.col("n_overlap").alias(f"ftroi_{infix}abs_num"))
    if wanted & {"coverage", "all"}:
        out.append((F.col("bp_overlap") / (F.col("end") - F.col("start")) * 100).alias(f"ftroi_{infix}pct_cov"))
    return totals.select(*regions.columns, *out)


def signal_features(
    regions: DataFrame, tracks: Mapping[str, DataFrame], blocks: DataFrame | None = None
) -> DataFrame:
    """Add masked signal statistics per labelled track."""
    out = regions
    for label, runs in tracks.items():
        out = out.join(masked_stats(regions, runs, blocks, label), REGION)
    return out


# ---------------------------------------------------------------- motifs in bins


def bin_weighted_motifs(regions: DataFrame, motifs: DataFrame, bin_size: int) -> DataFrame:
    """Motif counts under each distinct region, bins weighted by their overlap: long form ``pct``.

    ``motifs`` holds ``chrom, bin, motif, count`` with ``bin`` the start of the bin.
    """
    bins = motifs.select(
        "chrom", F.col("bin").alias("start"), (F.col("bin") + bin_size).alias("end"), "motif", F.col("count").alias("n")
    )
    hits = iv.range_join(regions.select(*REGION).distinct(), bins)
    share = iv.overlap_length(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r")) / F.lit(bin_size)
    return (
        hits.groupBy(*REGION, F.col("motif_r").alias("motif"))
        .agg(F.sum(F.col("n_r") * share).alias("_sum"))
        .select(*REGION, "motif", (F.col("_sum") / (F.col("end") - F.col("start")) * 100).alias("pct"))
    )


def motif_features(regions: DataFrame, motifs: DataFrame, bin_size: int, columns: Sequence[str]) -> DataFrame:
    """Wide form: one column per known motif column, zero where absent."""
    long = bin_weighted_motifs(regions, motifs, bin_size)
    wide = long.groupBy(*REGION).pivot("motif", list(columns)).agg(F.max("pct"))
    return regions.join(wide, REGION, "left").fillna(0.0, subset=list(columns))


# ---------------------------------------------------------------- associated regions


def associated_features(
    samples: DataFrame,
    associated: DataFrame,
    label: str,
    runs: DataFrame,
    signal_label: str,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Add number, distances and signal of the regions associated with each sample's name.

    ``associated`` holds ``chrom, name, starts, ends, weights`` arrays. Windows are joined on
    their ``source``. Samples without association get zeros.
    """
    own = "source" if "source" in samples.columns else "name"
    parts = associated.select(
        "chrom", F.col("name").alias(own), F.posexplode(F.arrays_zip("starts", "ends", "weights")).alias("idx", "p")
    ).select("chrom", own, "idx", F.col("p.starts").alias("start"), F.col("p.ends").alias("end"), F.col("p.weights").alias("wt"))
    stats = masked_stats(parts, runs, blocks, "x")
    s = "ftmsig_x_"
    valued = parts.join(stats, REGION).select(
        "chrom",
        own,
        "idx",
        "wt",
        (F.col("start") + F.expr("(end - start) div 2")).alias("mid"),
        *[F.col(f"{s}abs_{m}").alias(m) for m in ("min", "max", "median", "mean")],
    )
    here = samples.select(own, *REGION).distinct().withColumn("_mid", F.col("start") + F.expr("(end - start) div 2"))
    pairs = here.join(valued, ["chrom", own]).withColumn("dist", F.abs(F.col("mid") - F.col("_mid")))
    p, q = f"ftasc_{label}_", f"ftasc_{label}_{signal_label}_"
    nearest = F.struct("dist", "idx")
    folds = [
        F.count(F.lit(1)).alias(p + "abs_num"),
        F.avg("dist").alias(p + "abs_dist_mean"),
        F.min("dist").alias(p + "abs_dist_min"),
        F.max("dist").alias(p + "abs_dist_max"),
    ]
    for m in ("min", "max", "median", "mean"):
        folds.append(F.avg(m).alias(f"{q}abs_{m}"))
        folds.append((F.sum(F.col(m) * F.col("wt")) / F.sum("wt")).alias(f"{q}abs_wt-{m}"))
        folds.append(F.min_by(m, nearest).alias(f"{q}abs_nx-{m}"))
    keys = [*REGION, own]
    made = pairs.groupBy(*keys).agg(*folds)
    names = [c for c in made.columns if c not in keys]
    return samples.join(made, keys, "left").fillna(0, subset=names)

"""Ingest: bedGraph, BED, alignment maps, chains and motif hits into dataset containers."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import assembly_name, matches_from_start, region_order
from ..operators import intervals as iv
from ..operators.qnorm import nonzero_qnorm
from ..operators.signal import axis_pieces, merge_samples, overlay_last_wins, signal_deciles
from ..operators.tables import concat_common, row_number_by_position
from ..operators.values import clip_percentile, top_percent
from ..session import cut_lineage
from ..sources import store, text
from ..sources.chain import parse_chain_lines

log = logging.getLogger(__name__)


# ---------------------------------------------------------------- signal


def load_track(spark: SparkSession, path: str, sizes: DataFrame, clip: float) -> DataFrame:
    """One bedGraph file as disjoint runs, cut to the chromosomes and clipped at a percentile.

    Checkpointed: the steps that follow read the track several times.
    """
    lines = text.read_bedgraph(spark, path).join(sizes, "chrom")
    lines = lines.select(
        "chrom", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "size").alias("end"), "value", "line_no"
    ).filter(F.col("end") > F.col("start"))
    if iv.overlapping_rows(lines).isEmpty():
        runs = lines.drop("line_no")
    else:
        runs = overlay_last_wins(lines, "line_no")
    runs = cut_lineage(runs)
    if clip >= 100:
        return runs
    length = F.col("end") - F.col("start")
    used = runs.groupBy("chrom").agg(F.sum(length).alias("used"))
    zeros = sizes.join(used, "chrom").select("chrom", (F.col("size") - F.col("used")).alias("n_zero"))
    return cut_lineage(clip_percentile(runs, ["chrom"], "value", clip, length, zeros))


def normalise_tracks(tracks: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Quantile-normalised runs of several tracks: ``chrom, start, end, sample, value``.

    Tracks are cut at each other's boundaries; a piece counts as often as it has positions.
    """
    pieces = axis_pieces(dict(zip([f"s{i}" for i in range(len(tracks))], tracks)))
    values = F.array(*[F.struct(F.lit(n).alias("sample"), F.coalesce(f"s{i}", F.lit(0.0)).alias("value")) for i, n in enumerate(names)])
    wide = pieces.select("chrom", F.col("start").alias("pos"), (F.col("end") - F.col("start")).alias("w"), F.explode(values).alias("v"))
    normed = nonzero_qnorm(cut_lineage(wide.select("chrom", "pos", "w", "v.*")))
    return normed.select("chrom", F.col("pos").alias("start"), (F.col("pos") + F.col("w")).alias("end"), "sample", "value")


def convert_signal(
    spark: SparkSession,
    files: Sequence[str],
    sizes_path: str,
    select: str,
    *,
    qnorm: bool = True,
    merge_stat: str = "mean",
    clip: float = 99.95,
    dec_ranks: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Runs of the (merged) signal and the chromosome sizes. Chromosomes without signal are left out."""
    if not 0 <= clip <= 100:
        raise ValueError(f"clip percentile out of range: {clip}")
    sizes = text.read_chrom_sizes(spark, sizes_path, select)
    tracks = [load_track(spark, f, sizes, clip) for f in files]
    if len(tracks) == 1:
        runs = tracks[0]
    else:
        if qnorm:
            spans = normalise_tracks(tracks, list(files))
        else:
            pieces = axis_pieces({f"s{i}": t for i, t in enumerate(tracks)})
            cells = F.array(*[F.col(f"s{i}") for i in range(len(tracks))])
            spans = pieces.select("chrom", "start", "end", F.explode(cells).alias("value")).filter("value is not null")
        runs = merge_samples(spans, ["chrom", "start", "end"], merge_stat, len(tracks))
    runs = cut_lineage(runs.filter(F.col("value") != 0))
    if dec_ranks:
        runs = signal_deciles(runs).select("chrom", "start", "end", F.col("dec_rank").alias("value"))
    return runs.select("chrom", "start", "end", "value"), sizes


# ---------------------------------------------------------------- regions


def load_regions(
    spark: SparkSession,
    path: str,
    select: str,
    *,
    use_header: bool = False,
    name_index: int = -1,
    score_index: int = -1,
    keep_top: float = 95,
    min_size: int = 0,
) -> DataFrame:
    """One BED-like file: chromosome, size and score filters, columns in standard order."""
    table = text.read_bed(spark, path, use_header=use_header, name_index=name_index, score_index=score_index)
    table = table.filter(matches_from_start(F.col("chrom"), select))
    if min_size > 0:
        table = table.filter(F.col("end") - F.col("start") >= min_size)
    if score_index != -1 and keep_top < 100:
        score = table.columns[score_index]
        spread = table.agg(F.var_samp(score)).first()[0]
        if not spread:
            raise ValueError(f"scores in column {score_index} of {path} do not vary")
        table = top_percent(table, score, keep_top)
    if not use_header:
        table = table.select(*[c for c in table.columns if c in ("chrom", "start", "end", "name")])
    return table.select(*region_order(table.columns))


def convert_regions(spark: SparkSession, files: Sequence[str], select: str, **options) -> DataFrame:
    """Regions of one file, or the merged overlaps of several; unnamed regions are numbered in order."""
    if not 1 <= options.get("keep_top", 95) <= 100:
        raise ValueError("keep-top must lie between 1 and 100 percent")
    if options.get("use_header") and len(files) > 1:
        raise ValueError("a header can only be used with a single input file")
    tables = [load_regions(spark, f, select, **options) for f in files]
    regions = tables[0] if len(tables) == 1 else concat_common(tables)
    if len(tables) > 1:
        if "name" in regions.columns:
            regions = iv.merge_with_names(regions).drop("n_merged")
        else:
            regions = iv.islands(regions)
    if "name" not in regions.columns:
        regions = row_number_by_position(regions, "_i").select(
            *regions.columns, F.concat(F.lit("region_"), "_i").alias("name")
        )
    return regions.select(*region_order(regions.columns))


# ---------------------------------------------------------------- maps, chains, motifs


def check_disjoint(blocks: DataFrame, side: str) -> None:
    """Alignment blocks may not overlap on either side."""
    spans = blocks.select(
        F.col(f"{side}chrom").alias("chrom"), F.col(f"{side}start").alias("start"), F.col(f"{side}end").alias("end")
    )
    found = iv.overlapping_rows(spans).first()
    if found is not None:
        raise ValueError(f"overlapping blocks at {found['chrom']}:{found['start']}-{found['end']}")


def convert_map(
    spark: SparkSession,
    path: str,
    target_sizes: str,
    query_sizes: str,
    select: str,
    index_column: int,
    target: str = "",
    query: str = "",
    minimal: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Blocks of a map file with their container metadata.

    Masks and splits are derived on demand from the blocks, so ``minimal`` only marks the map.
    """
    blocks = text.read_map(spark, path, index_column)
    t_sizes, q_sizes = text.read_chrom_sizes(spark, target_sizes, select), text.read_chrom_sizes(spark, query_sizes, select)
    used_t = t_sizes.join(blocks.select(F.col("tchrom").alias("chrom")).distinct(), "chrom", "left_semi")
    used_q = q_sizes.join(blocks.select(F.col("qchrom").alias("chrom")).distinct(), "chrom", "left_semi")
    known = blocks.join(t_sizes.select(F.col("chrom").alias("tchrom")), "tchrom", "left_anti")
    if not known.isEmpty():
        raise ValueError("the map names target chromosomes without size")
    for side in "tq":
        check_disjoint(blocks, side)
    metadata = store.map_metadata(
        spark, assembly_name(target, target_sizes), assembly_name(query, query_sizes), "md5", text.read_checksum(spark, path), used_t, used_q, minimal
    )
    return blocks, metadata


def convert_chain(spark: SparkSession, path: str, select: str, target: str, query: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of a chain file with the same metadata as a map.

    A block's id is the number of its line, so ids are unique and grow along the file whatever the chains are called.
    Files without blocks of the selected chromosomes, and blocks that overlap on either side, are errors.
    """
    from ..sources.chain import chrom_sizes_from_chain

    lines = text.numbered_lines(spark, path)
    blocks = parse_chain_lines(lines, select, select, with_line=True)
    numbered = cut_lineage(blocks.withColumn("blockid", F.col("line_no")).drop("line_no", "score"))
    if numbered.isEmpty():
        raise ValueError(f"no blocks from {path} match {select}")
    for side in "tq":
        check_disjoint(numbered, side)
    metadata = store.map_metadata(
        spark, target, query, "md5", text.read_checksum(spark, path), chrom_sizes_from_chain(lines), chrom_sizes_from_chain(lines, False), False
    )
    return numbered, metadata


def convert_motifs(spark: SparkSession, files: Sequence[str], database: str, form: str) -> DataFrame:
    """Motif counts per bin under the feature name of each known motif, long form; unknown motifs are dropped.

    ``width`` is the width of all bins. A bin that starts at no multiple of it fails the job.
    """
    names = text.read_motif_names(spark, database, form)
    counts = text.read_binned_motifs(spark, list(files))
    width = F.lit(text.motif_bin_width(spark, list(files))).cast("bigint")
    on_grid = counts.filter(F.assert_true(F.col("bin") % width == 0, F.concat_ws(" ", F.lit("bin off the grid:"), "chrom", "bin")).isNull())
    return on_grid.join(names, "motif").select(
        "chrom", "bin", F.col("label").alias("motif"), F.col("count").cast("bigint").alias("count"), width.alias("width")
    )

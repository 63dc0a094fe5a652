"""Text sources: chromosome sizes, BED, bedGraph, maps, motif and association tables.

Compressed files are recognised by their extension by Spark's readers.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import check_column_names, matches_from_start, split_header, suspicious_headers

# Fixed value: delimiters a table may use.
DELIMITERS = " \t,"


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("t"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with a number that grows along the file: ``line_no, value``.

    The number is the byte offset of the line's split plus its place in the split, which is
    smaller than the next split's offset because every line takes at least one byte.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id")
    )
    first = raw.groupBy("_b").agg(F.min("_id").alias("_first"))
    return raw.join(first, "_b").select((F.col("_b") + F.col("_id") - F.col("_first")).alias("line_no"), "value")


def read_chrom_sizes(spark: SparkSession, path: str, keep: str = r"\w+") -> DataFrame:
    """``chrom, size`` of the chromosomes whose name matches from its start."""
    t = _tokens(spark.read.text(path))
    sizes = t.select(F.element_at("t", 1).alias("chrom"), F.element_at("t", 2).cast("bigint").alias("size"))
    sizes = sizes.filter(matches_from_start(F.col("chrom"), keep))
    if sizes.isEmpty():
        raise ValueError(f"no chromosomes from {path} match {keep}")
    return sizes


def sniff_table(spark: SparkSession, path: str, use_header: bool) -> tuple[int, str, list[str]]:
    """Rows to skip, delimiter, and column names of a text table, judged by its first two lines."""
    head = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    if not head:
        raise ValueError(f"no lines in {path}")
    sample = "\n".join(head) + "\n"
    sniffer = csv.Sniffer()
    delimiter = sniffer.sniff(sample, delimiters=DELIMITERS).delimiter
    found = sniffer.has_header(sample)
    if use_header:
        names = split_header(head[0], delimiter)
        if not found and suspicious_headers(names):
            import logging

            logging.getLogger(__name__).warning("unusual column names in %s: %s", path, suspicious_headers(names))
        return 0, delimiter, names
    return int(found), delimiter, []


def bed_columns(names: list[str], name_index: int, score_index: int) -> list[str]:
    """Column names of a BED-like table: from its header, else by position."""
    if name_index in (0, 1, 2) or score_index in (0, 1, 2):
        raise ValueError("the first three columns are chromosome, start and end")
    if names:
        out = ["chrom", "start", "end", *names[3:]]
        if name_index != -1:
            out[name_index] = "name"
    else:
        out = ["chrom", "start", "end"]
        for i in range(3, max(name_index, score_index) + 1):
            out.append("name" if i == name_index else "score" if i == score_index else f"col{i}")
    return check_column_names(out, name_index)


def read_bed(
    spark: SparkSession, path: str, *, use_header: bool = False, name_index: int = -1, score_index: int = -1
) -> DataFrame:
    """BED-like table with typed coordinates, all other columns as text but the score."""
    skip, delimiter, names = sniff_table(spark, path, use_header)
    columns = bed_columns(names, name_index, score_index)
    score = columns[score_index] if score_index != -1 else None
    kinds = {"start": "bigint", "end": "bigint"}
    if score:
        kinds[score] = "double"
    has_header = use_header or skip == 1
    raw = spark.read.csv(path, sep=delimiter, header=has_header, ignoreLeadingWhiteSpace=True, inferSchema=False, enforceSchema=False)
    picked = raw.columns[: len(columns)]
    if len(picked) < len(columns):
        raise ValueError(f"{path} has {len(picked)} columns, {len(columns)} are named")
    return raw.select(*[F.col(f"`{old}`").cast(kinds.get(new, "string")).alias(new) for old, new in zip(picked, columns)])


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Signal lines ``chrom, start, end, value`` with their order in the file (``line_no``)."""
    lines = numbered_lines(spark, path).filter((F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    t = F.split(F.trim("value"), r"\s+")
    return lines.select(
        F.element_at(t, 1).alias("chrom"),
        F.element_at(t, 2).cast("bigint").alias("start"),
        F.element_at(t, 3).cast("bigint").alias("end"),
        F.element_at(t, 4).cast("double").alias("value"),
        "line_no",
    )


def read_map(spark: SparkSession, path: str, index_column: int) -> DataFrame:
    """Alignment map TSV: eight columns plus the block index at a given position; strands become 1 / -1."""
    fields = [
        "tchrom string", "tstart bigint", "tend bigint", "tstrand string",
        "qchrom string", "qstart bigint", "qend bigint", "qstrand string",
    ]
    fields.insert(index_column, "blockid bigint")
    raw = spark.read.schema(", ".join(fields)).csv(path, sep="\t")
    return raw.withColumn("qstrand", F.when(F.col("qstrand") == "-", -1).otherwise(1)).select(
        "blockid", "tchrom", "tstart", "tend", "tstrand", "qchrom", "qstart", "qend", "qstrand"
    )


def map_super_blocks(blocks: DataFrame) -> DataFrame:
    """Number runs of consecutive blocks of one chromosome pair (``super_block``, from 1), in block order."""
    from ..operators.scan import position_tile, prefix_scan

    pair = F.concat_ws("\t", "tchrom", "qchrom")
    tile = position_tile(F.col("blockid"))
    previous = prefix_scan(blocks, [], "blockid", tile, {"_prev": ("max", F.col("blockid"))}, blocks=True)
    before = blocks.select(F.col("blockid").alias("_prev"), pair.alias("_pair"))
    steps = previous.join(before, "_prev", "left").withColumn(
        "_new", F.when(F.col("_pair").isNull() | (F.col("_pair") != pair), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    )
    scanned = prefix_scan(steps, [], "blockid", tile, {"super_block": ("sum", F.col("_new"))}, inclusive=True, blocks=True)
    return scanned.select(*blocks.columns, "super_block")


def read_associated(spark: SparkSession, path: str) -> DataFrame:
    """Associated regions: tab-separated with header, comma lists of starts, ends and optional weights."""
    raw = spark.read.csv(path, sep="\t", header=True)
    missing = {"chrom", "name", "starts", "ends"} - set(raw.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} missing in {path}")

    def numbers(column: str, kind: str):
        return F.transform(F.split(column, ","), lambda x: x.cast(kind))

    starts = numbers("starts", "bigint")
    weights = numbers("weights", "double") if "weights" in raw.columns else F.transform(starts, lambda _: F.lit(1.0))
    return raw.select("chrom", "name", starts.alias("starts"), numbers("ends", "bigint").alias("ends"), weights.alias("weights"))


def read_motif_names(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Known motifs (``motif, label``) from a word list, a two-column map, or a MEME database."""
    lines = spark.read.text(path)
    if form == "list":
        words = lines.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("motif")).filter("motif != ''").distinct()
        return words.select("motif", F.concat(F.lit("fttfm_pct_"), "motif").alias("label"))
    if form == "map":
        pairs = _tokens(lines).select(F.element_at("t", 1).alias("motif"), F.element_at("t", 2).alias("title"))
    elif form == "meme":
        pairs = (
            _tokens(lines)
            .filter(F.element_at("t", 1) == "MOTIF")
            .select(F.element_at("t", 2).alias("motif"), F.element_at("t", 3).alias("title"))
        )
    else:
        raise ValueError(f"unknown motif database format: {form}")
    return pairs.select("motif", F.concat(F.lit("fttfm_pct_"), "motif", F.lit("-"), "title").alias("label"))


def read_binned_motifs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Motif hits intersected with bins, summed to ``chrom, bin, motif, count``; order does not matter."""
    t = _tokens(spark.read.text(paths))
    rows = t.select(
        F.element_at("t", 1).alias("chrom"),
        F.element_at("t", 2).cast("bigint").alias("bin"),
        F.element_at("t", 7).alias("motif"),
        F.element_at("t", 8).cast("bigint").alias("ovl"),
    )
    return rows.groupBy("chrom", "bin", "motif").agg(F.sum("ovl").alias("count"))


def motif_bin_width(spark: SparkSession, paths: str | list[str]) -> int | None:
    """Width of the bins of binned motif hits: that of the longest, as the last bin of a chromosome may be cut short."""
    t = _tokens(spark.read.text(paths))
    return t.agg(F.max(F.element_at("t", 3).cast("bigint") - F.element_at("t", 2).cast("bigint"))).first()[0]


def read_checksum(spark: SparkSession, path: str) -> str:
    """MD5 of a file, streamed in blocks by one task."""
    import hashlib

    digest = hashlib.md5()
    local = path.removeprefix("file:")
    with open(local, "rb") as handle:
        while block := handle.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()

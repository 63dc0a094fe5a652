"""The dataset container: Parquet partitioned by group and chromosome, with a metadata table.

``<path>/data`` holds the rows, ``<path>/metadata/rev=<n>`` one metadata revision per write;
readers use the last one.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.names import chrom_name, flatten_nested, group_path, matches_from_start

# Metadata columns of each kind of dataset.
REGION_METADATA = ["group", "chrom", "mtime", "size_mb", "numreg", "covbp", "srcfile"]
SIGNAL_METADATA = ["group", "chrom", "mtime", "size_mb", "length", "signaltype", "srcfile"]
FEATURE_METADATA = [
    "group", "chrom", "mtime", "size_mb", "numsamples", "resolution", "features", "kmers", "srcfile", "indexfile",
]
MAP_METADATA = ["key", "value"]
KINDS = {"regions": REGION_METADATA, "signal": SIGNAL_METADATA, "features": FEATURE_METADATA, "map": MAP_METADATA}


def _source_names(files) -> str:
    return ",".join(str(f).rstrip("/").rsplit("/", 1)[-1] for f in flatten_nested(files))


def _frame(folded: DataFrame, group: str, columns: Sequence[str], width: int, rows: str) -> DataFrame:
    size = (F.col(rows) * width * 8 / (1024 * 1024)).cast("bigint")
    path = F.concat(F.lit(group_path(group).rstrip("/") + "/"), "chrom")
    made = folded.withColumns({"group": path, "mtime": F.current_timestamp(), "size_mb": size})
    return made.select(*columns)


def region_metadata(regions: DataFrame, group: str, files) -> DataFrame:
    """Regions and covered bases per chromosome; a region of length < 1 fails the job."""
    from ..operators.intervals import check_regions

    named = check_regions(regions).withColumn("chrom", chrom_name(F.col("chrom")))
    folded = named.groupBy("chrom").agg(
        F.count(F.lit(1)).alias("numreg"), F.sum(F.col("end") - F.col("start")).alias("covbp")
    ).withColumn("srcfile", F.lit(_source_names(files)))
    return _frame(folded, group, REGION_METADATA, len(regions.columns), "numreg")


def signal_metadata(runs: DataFrame, sizes: DataFrame, group: str, files) -> DataFrame:
    """Length and kind of signal per chromosome: ``pctranks`` for integers, else ``values``."""
    kind = "values" if runs.schema["value"].dataType.simpleString() in ("double", "float") else "pctranks"
    present = runs.select("chrom").distinct()
    folded = sizes.join(present, "chrom", "left_semi").select(
        chrom_name(F.col("chrom")).alias("chrom"),
        F.col("size").alias("length"),
        F.lit(kind).alias("signaltype"),
        F.lit(_source_names(files)).alias("srcfile"),
    )
    return _frame(folded, group, SIGNAL_METADATA, 1, "length")


def feature_metadata(
    samples: DataFrame, group: str, files, resolution: int | None, features: Sequence[str], kmers: Sequence[int], mapfile: str = ""
) -> DataFrame:
    """Samples per chromosome and how their features were made."""
    folded = samples.groupBy("chrom").agg(F.count(F.lit(1)).alias("numsamples")).withColumns(
        {
            "resolution": F.lit("N/A" if resolution is None else str(resolution)),
            "features": F.lit(",".join(features)),
            "kmers": F.lit(",".join(map(str, kmers))),
            "srcfile": F.lit(_source_names(files)),
            "indexfile": F.lit(_source_names(mapfile) if mapfile else "n/a"),
        }
    )
    return _frame(folded, group, FEATURE_METADATA, len(samples.columns), "numsamples")


def map_metadata(
    spark: SparkSession, target: str, query: str, hash_type: str, digest: str, target_sizes: DataFrame, query_sizes: DataFrame, minimal: bool
) -> DataFrame:
    """Key/value rows: assemblies, checksum, map type, and ``<assembly>/<chrom>`` sizes."""
    fixed = [("target", target), ("query", query), ("hashtype", hash_type), ("hash", digest), ("maptype", "minimal" if minimal else "complete")]
    rows = spark.createDataFrame(fixed, "key string, value string")
    for assembly, sizes in ((target, target_sizes), (query, query_sizes)):
        rows = rows.unionByName(
            sizes.select(F.concat(F.lit(assembly + "/"), "chrom").alias("key"), F.col("size").cast("string").alias("value"))
        )
    return rows


def upsert_metadata(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """New rows replace old rows of the same group (or key)."""
    if old is None:
        return new
    key = "group" if "group" in new.columns else "key"
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def read_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        revisions = spark.read.option("mergeSchema", "true").parquet(f"{path}/metadata")
    except AnalysisException:
        return None
    last = revisions.agg(F.max("rev")).first()[0]
    return revisions.filter(F.col("rev") == last).drop("rev")


def _revision(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(f"{path}/metadata").agg(F.max("rev")).first()[0] + 1
    except AnalysisException:
        return 0


def write_group(df: DataFrame, path: str, group: str, metadata: DataFrame | Callable[[DataFrame], DataFrame], mode: str = "w") -> None:
    """Write one group. ``w`` replaces the container, ``a`` only the chromosomes written.

    Rows are clustered by chromosome with a salt, so that each chromosome is written by
    several tasks, and sorted inside each file. ``metadata`` may be a function of the rows as they are stored: it then reads
    what was written, so the pipeline behind ``df`` runs once, and files it was read from may be the ones replaced.
    """
    spark = df.sparkSession
    named = df.withColumns({"chrom": chrom_name(F.col("chrom")) if "metadata" not in df.columns else F.col("chrom"), "group": F.lit(group.strip("/") or "default")})
    order = [c for c in ("group", "chrom", "start", "end") if c in named.columns]
    parts = named.repartition(*[F.col("group"), F.col("chrom"), (F.col("start") / (1 << 24)).cast("bigint")]) if "start" in named.columns else named
    writer = parts.sortWithinPartitions(*order).write.partitionBy("group", "chrom").mode("overwrite")

    def described() -> DataFrame:
        if isinstance(metadata, DataFrame):
            return metadata
        stored = spark.read.schema(named.schema).parquet(f"{path}/data").filter(F.col("group") == (group.strip("/") or "default"))
        return metadata(stored.select(*df.columns))

    if mode == "a":
        old = read_metadata(spark, path)
        writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{path}/data")
        merged = upsert_metadata(old, described())
        merged.coalesce(1).write.mode("append").parquet(f"{path}/metadata/rev={_revision(spark, path)}")
    else:
        writer.parquet(f"{path}/data")
        described().coalesce(1).withColumn("rev", F.lit(0)).write.mode("overwrite").partitionBy("rev").parquet(f"{path}/metadata")


def default_group(spark: SparkSession, path: str) -> str:
    """The only group of a container; more than one is an error."""
    groups = list_groups(spark, path)
    if len(groups) != 1:
        raise ValueError(f"{path} has {len(groups)} groups, name one: {groups}")
    return groups[0]


def list_groups(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    found = spark.read.option("mergeSchema", "true").parquet(f"{path}/data").select("group").distinct().collect()
    return sorted(r["group"] for r in found if r["group"].startswith(prefix.strip("/")))


def list_chroms(spark: SparkSession, path: str, verify: bool = False) -> list[str]:
    """Chromosomes named by the metadata; ``verify`` checks that the data holds no other."""
    chroms = sorted(r["chrom"] for r in read_metadata(spark, path).select("chrom").distinct().collect())
    if verify:
        stored = {r["chrom"] for r in spark.read.parquet(f"{path}/data").select("chrom").distinct().collect()}
        if stored - set(chroms):
            raise ValueError(f"chromosomes without metadata in {path}: {sorted(stored - set(chroms))}")
    return chroms


def read_group(spark: SparkSession, path: str, group: str = "", chroms: str = "") -> DataFrame:
    """Rows of a group (the only one unless named), pruned to chromosomes that match a pattern."""
    wanted = group.strip("/") or default_group(spark, path)
    data = spark.read.option("mergeSchema", "true").parquet(f"{path}/data").filter(F.col("group") == wanted).drop("group")
    if data.isEmpty():
        raise KeyError(f"no group {wanted} in {path}")
    lead = ["chrom", *[c for c in data.columns if c != "chrom"]]
    data = data.select(*lead)
    return data.filter(matches_from_start(F.col("chrom"), chroms)) if chroms else data


def dataset_kind(spark: SparkSession, path: str) -> str | None:
    """``regions``, ``signal``, ``features`` or ``map``, told from the metadata columns."""
    metadata = read_metadata(spark, path)
    if metadata is None:
        return None
    return next((kind for kind, columns in KINDS.items() if set(columns) == set(metadata.columns)), None)


def sizes_from_map(spark: SparkSession, path: str, which: str, select: str = r"\w+") -> DataFrame:
    """``chrom, size`` of the target or query assembly of a map container."""
    metadata = read_metadata(spark, path)
    assembly = assembly_of_map(spark, path, which)
    return (
        metadata.filter(F.col("key").startswith(assembly + "/"))
        .select(F.element_at(F.split("key", "/"), 2).alias("chrom"), F.col("value").cast("bigint").alias("size"))
        .filter(matches_from_start(F.col("chrom"), select))
    )


def assembly_of_map(spark: SparkSession, path: str, which: str) -> str:
    row = read_metadata(spark, path).filter(F.col("key") == which).first()
    if row is None:
        raise KeyError(f"no {which} assembly in {path}")
    return row["value"]


def read_blocks(
    spark: SparkSession,
    path: str,
    targets: str = "",
    queries: str = "",
    *,
    chroms: tuple[Collection[str] | None, Collection[str] | None] = (None, None),
    span: tuple[int, int] | None = None,
) -> DataFrame:
    """Alignment blocks of a map container, those of the chromosome pairs asked for.

    ``targets`` and ``queries`` are patterns, ``chroms`` are lists of target and query chromosomes: both select folders, so
    no block of another pair is read. ``span`` keeps blocks that meet [start, end) on the target; files are sorted by
    it, so most row groups are passed over.
    """
    stored = spark.read.parquet(f"{path}/data")
    for column, pattern, names in (("chrom", targets, chroms[0]), ("qside", queries, chroms[1])):
        source = F.col(column if column in stored.columns else "qchrom")  # maps of older versions have no query folders
        if pattern:
            stored = stored.filter(matches_from_start(source, pattern))
        if names is not None:
            stored = stored.filter(source.isin(*names))
    if span is not None:
        stored = stored.filter((F.col("tstart") < span[1]) & (F.col("tend") > span[0]))
    return stored.drop("group", "chrom", "qside")


def conserved_blocks(spark: SparkSession, path: str, which: str, chroms: Collection[str] | None = None) -> DataFrame:
    """Blocks of a map container as intervals of the target or query side, on ``chroms`` if given."""
    side = which[0]
    return read_blocks(spark, path, chroms=(chroms, None) if side == "t" else (None, chroms)).select(
        F.col(f"{side}chrom").alias("chrom"), F.col(f"{side}start").alias("start"), F.col(f"{side}end").alias("end")
    )


def write_map(blocks: DataFrame, path: str, metadata: DataFrame) -> None:
    """Blocks in a folder for each pair of chromosomes, sorted by target position, with key/value metadata."""
    stored = blocks.withColumns({"group": F.lit("blocks"), "chrom": F.col("tchrom"), "qside": F.col("qchrom")})
    salted = stored.repartition("chrom", "qside", (F.col("tstart") / (1 << 24)).cast("bigint"))
    salted.sortWithinPartitions("chrom", "qside", "tstart").write.mode("overwrite").partitionBy("group", "chrom", "qside").parquet(f"{path}/data")
    metadata.coalesce(1).withColumn("rev", F.lit(0)).write.mode("overwrite").partitionBy("rev").parquet(f"{path}/metadata")

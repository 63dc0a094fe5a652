"""Text output of stored regions, maps and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import MAP_ORDER, bed_order
from ..operators.tables import row_number_by_position


def map_rows(blocks: DataFrame, reference: str, full: bool) -> DataFrame:
    """Alignment blocks in the column order of the target or query view."""
    shown = blocks.withColumn("tstrand", F.lit("+")).withColumn(
        "qstrand", F.when(F.col("qstrand") == -1, F.lit("-")).otherwise(F.lit("+"))
    )
    return shown.select(*MAP_ORDER[reference, full])


def sorted_map(blocks: DataFrame, reference: str, full: bool) -> DataFrame:
    first, second = ("t", "q") if reference == "target" else ("q", "t")
    return blocks.orderBy(f"{first}chrom", f"{second}chrom", f"{first}start", f"{first}end").transform(
        lambda d: map_rows(d, reference, full)
    )


def region_rows(regions: DataFrame, group: str, comment_header: bool = False) -> DataFrame:
    """Regions in BED column order with the group they came from and their place in it."""
    columns = [c for c in regions.columns if c != "group"]
    out = row_number_by_position(regions.select(*columns), "group_index")
    out = out.withColumn("group_path", F.concat(F.lit("/" + group.strip("/") + "/"), "chrom"))
    out = out.select(*bed_order(out.columns)).orderBy("chrom", "start", "end")
    return out.withColumnRenamed("chrom", "#chrom") if comment_header else out

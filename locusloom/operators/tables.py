"""Merging, extending, stacking and subsetting of region tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_same_entries(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    """Both sides hold as many rows, and each left entry of a key column also occurs right."""
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"different number of data entries: {n_left} vs {n_right}")
    for column in on:
        if not left.join(right, column, "left_anti").isEmpty():
            raise ValueError(f"some entries of column {column} are not shared between datasets")


def merge_tables(
    tables: Sequence[DataFrame], labels: Sequence[str], on: Sequence[str], validate: bool = True
) -> DataFrame:
    """Full outer merge of N tables; columns outside the key get their table's label.

    ``start`` and ``end`` become the smallest start and largest end over the tables.
    """
    on = list(on)
    labelled = []
    for table, label in zip(tables, labels):
        if validate and labelled:
            check_same_entries(tables[0], table, on)
        rest = [c for c in table.columns if c not in on]
        labelled.append(table.select(*on, *[F.col(c).alias(f"{c}_{label}") for c in rest]))
    merged = reduce(lambda a, b: a.join(b, on, "full_outer"), labelled)
    starts = [f"start_{lab}" for lab in labels if f"start_{lab}" in merged.columns]
    ends = [f"end_{lab}" for lab in labels if f"end_{lab}" in merged.columns]
    bounds = []
    if starts:
        bounds.append((F.least(*starts) if len(starts) > 1 else F.col(starts[0])).alias("start"))
    if ends:
        bounds.append((F.greatest(*ends) if len(ends) > 1 else F.col(ends[0])).alias("end"))
    return merged.select("*", *bounds)


def extend_table(
    table: DataFrame,
    values: DataFrame,
    on: Sequence[str],
    columns: Sequence[str],
    label: str = "",
    *,
    whole_genome: bool = False,
    ignore_missing: bool = False,
    validate: bool = True,
) -> DataFrame:
    """Full outer merge with selected columns of a value table; clashing names get the label.

    ``whole_genome`` first cuts the values to the keys of the table; ``ignore_missing`` drops
    rows with a NULL afterwards.
    """
    on = list(on)
    if whole_genome:
        if len(on) != 1:
            raise ValueError("whole-genome values can be merged on one column only")
        values = values.join(table.select(*on).distinct(), on, "left_semi")
    if validate and not ignore_missing:
        check_same_entries(table, values, on)
    named = [F.col(c).alias(f"{c}_{label}" if label and c in table.columns else c) for c in columns]
    out = table.join(values.select(*on, *named), on, "full_outer")
    return out.dropna("any") if ignore_missing else out


def stack_tables(tables: Sequence[DataFrame], labels: Sequence[str], indicator: bool = False) -> DataFrame:
    """Union of tables without columns that hold a NULL and without duplicate rows.

    Of equal rows the one from the earliest table stays; ``indicator`` tells which that was.
    The NULL check is one aggregation over all columns, its result one row.
    """
    tagged = [t.withColumn("_src", F.lit(i)) for i, t in enumerate(tables)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    data = [c for c in stacked.columns if c != "_src"]
    nulls = stacked.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in data]).first()
    kept = [c for c in data if not nulls[c]]
    distinct = stacked.groupBy(*kept).agg(F.min("_src").alias("_src"))
    if not indicator:
        return distinct.select(*kept)
    names = F.array(*[F.lit(x) for x in labels])
    return distinct.select(F.element_at(names, F.col("_src") + 1).alias("indicator"), *kept)


def concat_common(tables: Sequence[DataFrame]) -> DataFrame:
    """Union on the columns all tables share."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(lambda a, b: a.unionByName(b), [t.select(*common) for t in tables])


def concat_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Union on all columns; absent ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def subset_by_expression(df: DataFrame, expression: str) -> DataFrame:
    return df.filter(F.expr(expression.strip('"')))


def subset_by_names(df: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    return df.join(names.select(F.col("name").alias(column)).distinct(), column, "left_semi")


def names_from_file(spark, path: str) -> DataFrame:
    """Sample names from a JSON document (``subset``) or whitespace-separated text."""
    lines = spark.read.text(path)
    if _starts_like_json(lines):
        document = spark.read.schema("subset array<string>").json(path, multiLine=True)
        names = document.select(F.explode("subset").alias("name"))
    else:
        names = lines.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).filter("name != ''")
    return names.distinct()


def weights_from_file(spark, path: str) -> DataFrame:
    """Sample weights from a JSON document (``sample_weights``: [[name, weight], ...]) or a table with header."""
    if _starts_like_json(spark.read.text(path)):
        document = spark.read.schema("sample_weights array<array<string>>").json(path, multiLine=True)
        pair = document.select(F.explode("sample_weights").alias("p"))
        return pair.select(F.element_at("p", 1).alias("name"), F.element_at("p", 2).cast("double").alias("weight"))
    return spark.read.schema("name string, weight double").csv(path, sep="\t", header=True, enforceSchema=True)


def _starts_like_json(lines: DataFrame) -> bool:
    first = lines.filter(F.trim("value") != "").first()
    return first is not None and first["value"].lstrip()[:1] in "{["


def names_from_metadata(spark, path: str, expression: str) -> DataFrame:
    """Names of a run's samples for which a SQL expression over ``name``, ``weight``, ``target``, ``pred`` holds.

    The reference form evaluates Python over the document; here it is a filter over a table.
    """
    with open(path, encoding="utf-8") as handle:
        document = json.load(handle)
    info = document.get("sample_info", {})
    names = info.get("names") or []
    columns: dict[str, list] = {"name": names}
    columns["weight"] = info.get("weights") or [None] * len(names)
    columns["target"] = info.get("targets") or [None] * len(names)
    tested = document.get("testing_info", document.get("estimate_info", {})).get("targets", {})
    columns["pred"] = tested.get("pred") or [None] * len(names)
    rows = list(zip(*[[None if v is None else (v if c == "name" else float(v)) for v in vs] for c, vs in columns.items()]))
    schema = "name string, weight double, target double, pred double"
    return spark.createDataFrame(rows, schema).filter(F.expr(expression)).select("name")


def add_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Full outer merge with sample weights on the name."""
    return df.drop("weight").join(weights.select("name", "weight"), "name", "full_outer")


_TARGET_TYPES = [
    ((T.BooleanType,), "tinyint", "bool/int8"),
    ((T.FloatType, T.DoubleType, T.DecimalType), "double", "float/float64"),
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "bigint", "int/int64"),
]


def add_target(df: DataFrame, column: str | None = None, expression: str | None = None) -> tuple[DataFrame, str, str]:
    """Target variable: an existing column, or an expression over ``data.<column>`` named ``target``.

    Returns the table, the target's name and its type. Booleans become small integers.
    """
    if column:
        if column not in df.columns:
            raise ValueError(f"target variable {column} is not a column")
        name, out = column, df
    else:
        if not expression or "data." not in expression:
            raise ValueError(f'no "data." reference in target expression: {expression}')
        name, out = "target", df.alias("data").select("*", F.expr(expression.strip('"')).alias("target"))
    kind = out.schema[name].dataType
    for types, cast, label in _TARGET_TYPES:
        if isinstance(kind, types):
            out = out.withColumn(name, F.col(name).cast(cast))
            break
    else:
        raise TypeError(f"cannot use {kind.simpleString()} as target type")
    if out.select(name).distinct().limit(2).count() < 2:
        raise ValueError(f"fewer than two distinct targets for {name}")
    return out, name, label


def sample_name_column(columns: Sequence[str]) -> str | None:
    """First of the columns that name samples."""
    return next((c for c in columns if c in ("name", "source")), None)


def row_number_by_position(df: DataFrame, name: str = "idx") -> DataFrame:
    """Row index in (chrom, start, end, rest) order, from 0, without a global sort in one task.

    Rows before a row are those of earlier chromosomes, of smaller starts, and of the same
    start; only the last group is sorted, and identical rows are folded to a count first.
    """
    from pyspark.sql import Window

    from .scan import position_tile, prefix_scan

    folded = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    starts = folded.groupBy("chrom", "start").agg(F.sum("_copies").alias("_n"))
    below = prefix_scan(starts, ["chrom"], "start", position_tile(F.col("start")), {"_below": ("sum", F.col("_n"))})
    chroms = starts.groupBy("chrom").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy(F.lit(0)).orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chroms.select("chrom", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_offset"))
    rest = [c for c in df.columns if c not in ("chrom", "start", "end")]
    peers = Window.partitionBy("chrom", "start").orderBy("end", *rest).rowsBetween(Window.unboundedPreceding, -1)
    first: Column = F.col("_offset") + F.col("_below") + F.coalesce(F.sum("_copies").over(peers), F.lit(0))
    placed = folded.join(below.select("chrom", "start", "_below"), ["chrom", "start"]).join(offsets, "chrom")
    return placed.withColumn("_first", first).select(
        *df.columns, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias(name)
    )

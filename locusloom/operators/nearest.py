"""The k nearest targets by Chebyshev distance over all features, without a radius.

A tree of median cuts over a bounded sample of the targets divides space into cells; what is known of a cell is
its number of targets and the box around them. A point first searches its own cell, or those nearest by their boxes
that hold k targets together, which bounds its k-th distance, and then every other cell whose box is no farther than that,
looked up from the root of the tree down: a proof that nothing is missed. Cells with many points or targets are searched in blocks, each in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread, workers_find_package

#: Targets the tree is grown on, about; its leaves, at most. Neither bounds what is searched.
SAMPLE, LEAVES = 1 << 17, 1 << 13
TARGETS, POINTS = 4_096, 8_192  # of a block


def grow_tree(sample: np.ndarray, leaves: int = LEAVES, least: int = 16) -> np.ndarray:
    """Nodes ``(feature, cut, left, right)`` of median cuts along the widest feature; a leaf has feature -1."""
    nodes, queue = [], [(np.arange(len(sample)), None)]
    at = 0
    while at < len(queue):
        rows, _ = queue[at]
        node = (-1.0, 0.0, 0.0, 0.0)
        if len(rows) >= 2 * least and len(queue) + 2 <= 2 * leaves:
            part = sample[rows]
            feature = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            cut = float(np.median(part[:, feature]))
            lower = part[:, feature] < cut
            if lower.any() and not lower.all():
                node = (float(feature), cut, float(len(queue)), float(len(queue) + 1))
                queue += [(rows[lower], None), (rows[~lower], None)]
        nodes.append(node)
        at += 1
    return np.array(nodes)


def leaf_of(tree: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Leaf of each point: all points go down one level at a time."""
    at = np.zeros(len(points), dtype=np.int64)
    while True:
        feature = tree[at, 0].astype(np.int64)
        inner = np.flatnonzero(feature >= 0)
        if len(inner) == 0:
            return at
        node = tree[at[inner]]
        low = points[inner, feature[inner]] < node[:, 1]
        at[inner] = np.where(low, node[:, 2], node[:, 3]).astype(np.int64)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Chebyshev distance of each point to each box (0 inside)."""
    out = np.zeros((len(points), len(low)))
    for f in range(points.shape[1]):
        x = points[:, f, None]
        np.maximum(out, np.maximum(low[None, :, f] - x, x - high[None, :, f]), out=out)
    return out


def node_boxes(tree: np.ndarray, cells: np.ndarray, held: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes around the targets beneath each node and their numbers, from those of the leaves (``cells``)."""
    lo, hi = np.full((len(tree), low.shape[1]), np.inf), np.full((len(tree), low.shape[1]), -np.inf)
    n = np.zeros(len(tree), dtype=np.int64)
    lo[cells], hi[cells], n[cells] = low, high, held
    for at in range(len(tree) - 1, -1, -1):  # children come after their parent
        if tree[at, 0] >= 0:
            two = tree[at, 2:].astype(np.int64)
            lo[at], hi[at], n[at] = lo[two].min(axis=0), hi[two].max(axis=0), n[two].sum()
    return lo, hi, n


def nearest_cells(
    tree: np.ndarray, node_held: np.ndarray, cells: np.ndarray, held: np.ndarray, low: np.ndarray, high: np.ndarray, points: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """``row, cell``: the leaf of a point if it holds ``k`` targets, else the cells nearest by their boxes that do together."""
    own = leaf_of(tree, points)
    enough = node_held[own] >= k
    row, cell = [np.flatnonzero(enough)], [own[enough]]
    few = np.flatnonzero(~enough)
    if len(few):
        order = np.argsort(box_distances(points[few], low, high), axis=1, kind="stable")
        mine = np.cumsum(held[order], axis=1) - held[order] < k
        at, place = np.nonzero(mine)
        row.append(few[at])
        cell.append(cells[order[at, place]])
    return np.concatenate(row), np.concatenate(cell).astype(np.int64)


def cells_within(tree: np.ndarray, low: np.ndarray, high: np.ndarray, held: np.ndarray, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, cell``: every leaf with targets whose box is no farther from a point than its bound, from the root down."""
    row, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    rows, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while len(row):
        x = points[row]
        near = (held[node] > 0) & (np.maximum(low[node] - x, x - high[node]).max(axis=1) <= bound[row])
        row, node = row[near], node[near]
        leaf = tree[node, 0] < 0
        rows.append(row[leaf])
        found.append(node[leaf])
        row, node = row[~leaf], node[~leaf]
        row, node = np.concatenate([row, row]), np.concatenate([tree[node, 2], tree[node, 3]]).astype(np.int64)
    return np.concatenate(rows), np.concatenate(found)


def _matrix(batch: pa.RecordBatch | pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in columns])


def _k_best(k: int, names: Sequence[str]):
    """Of one block of points and one of targets: the k nearest targets of each point."""

    def run(points: pa.Table, targets: pa.Table) -> pa.Table:
        schema = pa.schema([("_pid", pa.int64()), ("target_id", pa.int64()), ("dist", pa.float64())])
        if points.num_rows == 0 or targets.num_rows == 0:
            return schema.empty_table()
        x, y, ids, pids = _matrix(points, names), _matrix(targets, names), targets.column("id").to_numpy(), points.column("_pid").to_numpy()
        order = np.argsort(ids, kind="stable")  # so that a stable sort by distance breaks ties by id
        y, ids = y[order], ids[order]
        take, step, out = min(k, len(ids)), max(1, (1 << 21) // len(ids)), []
        for at in range(0, len(x), step):
            d = box_distances(x[at : at + step], y, y)
            best = np.argsort(d, axis=1, kind="stable")[:, :take]
            out.append((np.repeat(pids[at : at + step], take), ids[best].ravel(), np.take_along_axis(d, best, axis=1).ravel()))
        return pa.table([np.concatenate([o[i] for o in out]) for i in range(3)], schema=schema)

    return run


def _first(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_k(candidates: DataFrame, targets: DataFrame, features: Sequence[str], k: int = 1) -> DataFrame:
    """``id, rank, target_id, dist``: the ``k`` nearest targets of each candidate (all, if there are fewer), by distance,
    then by target id.

    Both tables have ``id`` (long) and the features; rows with a NULL or NaN among these are left out. Equal vectors are
    searched once on either side. Collected by the driver: the sample (``SAMPLE``) and one line for each leaf.
    """
    names, spark = list(features), candidates.sparkSession
    workers_find_package(spark)
    fine = " AND ".join(f"`{n}` IS NOT NULL AND NOT isnan(`{n}`)" for n in names)
    typed = lambda df: df.select(F.col("id").cast("long").alias("id"), *[F.col(n).cast("double").alias(n) for n in names]).filter(fine)
    asked = cut_lineage(typed(candidates))
    # of equal targets only the k least ids matter; salted first, as one vector may be very common
    salted = _first(typed(targets).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))), [*names, "_salt"], ["id"], k)
    kept = cut_lineage(_first(salted.drop("rank", "_salt"), names, ["id"], k).drop("rank"))
    n = kept.count()
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = kept.filter(F.pmod(F.xxhash64("id", *names), F.lit(1 << 30)) < int(share * (1 << 30))).select(*names).toArrow()
    tree = grow_tree(_matrix(drawn, names) if drawn.num_rows else np.zeros((0, len(names))))

    def in_leaf(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield batch.append_column("_cell", pa.array(leaf_of(tree, _matrix(batch, names)) if batch.num_rows else np.zeros(0, dtype=np.int64)))

    shape = "".join(f", `{c}` double" for c in names)
    placed = cut_lineage(kept.mapInArrow(in_leaf, f"id long{shape}, _cell long"))
    boxes = placed.groupBy("_cell").agg(F.count("*").alias("n"), *[f(c).alias(f"{p}{i}") for i, c in enumerate(names) for p, f in (("lo", F.min), ("hi", F.max))]).orderBy("_cell").toArrow()
    cells, held = boxes.column("_cell").to_numpy(), boxes.column("n").to_numpy()
    low, high = (_matrix(boxes, [f"{p}{i}" for i in range(len(names))]) if len(cells) else np.zeros((0, len(names))) for p in ("lo", "hi"))
    node_low, node_high, node_held = node_boxes(tree, cells, held, low, high)
    parts = dict(zip(cells.tolist(), (-(-held // TARGETS)).tolist(), strict=True))

    points = cut_lineage(asked.select(*names).distinct().withColumn("_pid", F.monotonically_increasing_id()))

    def visits(second: bool):
        """Cells each point searches: at first its own leaf, or those nearest that together hold k targets if it holds
        fewer; then all others within its bound, found from the root down."""

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                step = max(1, (1 << 21) // max(len(cells), 1))
                for at in range(0, batch.num_rows if len(cells) else 0, step):
                    some = batch.slice(at, step)
                    x = _matrix(some, names)
                    first_row, first_cell = nearest_cells(tree, node_held, cells, held, low, high, x, k)
                    row, cell = first_row, first_cell
                    if second:
                        row, cell = cells_within(tree, node_low, node_high, node_held, x, some.column("bound").to_numpy())
                        new = ~np.isin(row * len(tree) + cell, first_row * len(tree) + first_cell)
                        row, cell = row[new], cell[new]
                    yield pa.RecordBatch.from_arrays([*[some.column(c).take(pa.array(row)) for c in ("_pid", *names)], pa.array(cell)], names=["_pid", *names, "_cell"])

        return run

    def searched(visitors: DataFrame) -> DataFrame:
        """The k best of each visit, block by block."""
        visitors = cut_lineage(visitors)
        crowd = {r["_cell"]: -(-r["count"] // POINTS) for r in visitors.groupBy("_cell").count().collect()}  # a line for each leaf
        if not crowd:
            return spark.createDataFrame([], "_pid long, target_id long, dist double")
        def dealt(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
            """Rows with a block of their own side, once for each block of the other side; the counts are one line for each leaf."""
            counts = spark.createDataFrame([(c, parts[c], m) for c, m in crowd.items()], "_cell long, _parts long, _crowds long")
            mine = df.join(F.broadcast(counts), "_cell").withColumn(f"_{own}", F.pmod(F.xxhash64(key), F.col(f"_{own}s")))
            return mine.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_{other}s") - 1))).drop("_parts", "_crowds")

        p = dealt(visitors, "crowd", "part", "_pid").groupBy("_cell", "_part", "_crowd")
        t = dealt(placed, "part", "crowd", "id").groupBy("_cell", "_part", "_crowd")
        return p.cogroup(t).applyInArrow(_k_best(k, names), "_pid long, target_id long, dist double")

    visited = f"_pid long{shape}, _cell long"
    best = cut_lineage(_first(searched(spread(points).select("_pid", *names).mapInArrow(visits(False), visited)), ["_pid"], ["dist", "target_id"], k).drop("rank"))
    bound = best.groupBy("_pid").agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = cut_lineage(points.join(bound, "_pid").select("_pid", *names, "bound"))
    more = searched(spread(bounded).mapInArrow(visits(True), visited))
    final = _first(best.unionByName(more), ["_pid"], ["dist", "target_id"], k)
    return asked.join(points, names).join(final, "_pid").select("id", F.col("rank").cast("long").alias("rank"), "target_id", "dist")

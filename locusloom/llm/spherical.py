"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one kept of each group.

Equal vectors are folded into one class first. Each class has a home cell, that of the nearest centroid, and
visits every other cell in which a vector at the wanted cosine might live: if ``y`` is at home in ``c`` and at
most a chord ``e`` from ``x``, then ``x . (h - c) <= e |h - c|`` for the home ``h`` of ``x``. Of two cells the pair
meets in the one of lower number, so each pair is compared once and no link is lost at a border. Cells are cut
into blocks; a task compares one block with one other, whatever a cell holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, written
from .components import components

BLOCK = 4_096  # vectors of a block
CELL = 4_096  # vectors a cell has on average, up to MOST_CELLS cells
MOST_CELLS = 1_024
SAMPLE = 16_384  # vectors the centroids are fitted on, at most
ROUNDS = 12
DENSE = 50_000  # links of two blocks above which only a spanning forest of them is passed on


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square overflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 9) -> np.ndarray:
    """``k`` unit centroids (fewer if there are fewer points) of unit vectors, by cosine."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(points)))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        home = (points @ centres.T).argmax(axis=1)
        order = np.argsort(home, kind="stable")
        present, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(points[order], first, axis=0)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        moved = centres.copy()
        fine = length[:, 0] > 1e-12
        moved[present[fine]] = sums[fine] / length[fine]
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def _valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, print, dims, bits``; the last three NULL for vectors that link with nothing."""
    schema = pa.schema([("vec_id", pa.int64()), ("print", pa.binary()), ("dims", pa.int32()), ("bits", pa.binary())])

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(part):
            prints, dims, bits = [], [], []
            for vec_id, scalar in zip(batch.column(0), batch.column(1), strict=True):
                raw = None
                if scalar.is_valid and vec_id.is_valid and len(scalar.values) and scalar.values.null_count == 0:
                    v = scalar.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0
                    if np.isfinite(v).all() and v.any():
                        raw = v.tobytes()
                prints.append(raw and xxhash.xxh3_128_digest(raw))
                dims.append(raw and len(raw) // 8)
                bits.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(dims, pa.int32()), pa.array(bits, pa.binary())], schema=schema)

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(
        run, "vec_id long, print binary, dims int, bits binary"
    )


def _stack(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dims)


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) that connect all rows and columns which ``linked`` connects."""
    n_rows, n_cols = linked.shape
    new_row, new_col = linked.any(axis=1), linked.any(axis=0)
    out_r, out_c = [], []
    for start in np.flatnonzero(new_row):
        if not new_row[start]:
            continue
        new_row[start], rows = False, np.array([start])
        while len(rows):
            found = linked[rows] & new_col
            cols = np.flatnonzero(found.any(axis=0))
            out_r.append(rows[found[:, cols].argmax(axis=0)])
            out_c.append(cols)
            new_col[cols] = False
            found = linked[:, cols] & new_row[:, None]
            rows = np.flatnonzero(found.any(axis=1))
            out_r.append(rows)
            out_c.append(cols[found[rows].argmax(axis=1)] if len(cols) else rows)
            new_row[rows] = False
    return (np.concatenate(out_r), np.concatenate(out_c)) if out_r else (np.zeros(0, int), np.zeros(0, int))


def _compare(threshold: float):
    """Links between the probes and the bases of one pair of blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        dims, same = group["dims"][0].as_py(), group["base"][0].as_py() == group["probe"][0].as_py()
        is_base = np.array(group["is_base"].to_pylist(), dtype=bool)
        ids, copies = np.array(group["id"].to_pylist(), dtype=np.int64), np.array(group["copies"].to_pylist(), dtype=np.int64)
        points = unit(_stack(group["bits"], dims))
        base = np.flatnonzero(is_base)
        probe = base if same else np.flatnonzero(~is_base)
        if not len(base) or not len(probe):
            return schema.empty_table()
        linked = np.zeros((len(probe), len(base)), dtype=bool)
        for lo in range(0, len(probe), 512):
            linked[lo : lo + 512] = points[probe[lo : lo + 512]] @ points[base].T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        of_probe = np.array([copies[base[row]].sum() for row in linked], dtype=np.int64)
        counted = [(ids[probe], of_probe)]
        if not same:
            counted.append((ids[base], np.array([copies[probe[col]].sum() for col in linked.T], dtype=np.int64)))
        some = int(linked.sum())
        r, c = np.nonzero(linked) if some <= DENSE else _forest(linked)
        a, n = np.concatenate([x[0] for x in counted]), np.concatenate([x[1] for x in counted])
        a, n = a[n > 0], n[n > 0]
        edges = pa.table([ids[probe[r]], ids[base[c]], np.zeros(len(r), dtype=np.int64)], schema=schema)
        counts = pa.table([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(n)], schema=schema)
        return pa.concat_tables([edges, counts])

    return run


def near_duplicate_vectors(vectors: DataFrame, *, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Rows link if the cosine of their vectors, in double precision, is at least ``cosine`` (above 0). ``n_links``
    counts the other rows linked directly, ``component_id`` is the least id reachable, ``kept`` marks it. NULL, empty
    and zero vectors, those with NULL or non-finite parts, and rows without an id link with nothing. Vectors of
    different lengths don't link. Ids should be unique; rows of one id and one vector count as copies.
    """
    spark = vectors.sparkSession
    rows = written(_valid(vectors, id_col, vector_col), "vectors")
    classes = written(
        rows.filter("print IS NOT NULL").groupBy("print", "dims").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("bits").alias("bits")), "classes"
    )
    # centroids for each length of vector, on a bounded sample of least hashes
    centres = {}
    for r in classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(MOST_CELLS).collect():
        sample = classes.filter(F.col("dims") == r.dims).select("bits", F.xxhash64("print").alias("h")).orderBy("h").limit(SAMPLE).collect()
        points = unit(np.frombuffer(b"".join(bytes(x.bits) for x in sample), dtype=np.float64).reshape(-1, r.dims))
        centres[r.dims] = spherical_kmeans(points, min(MOST_CELLS, -(-r["count"] // cell)))
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS vectors of each length
    chord = float(np.sqrt(2 - 2 * cosine))

    def place(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A class at home in its cell, and as a guest in cells of lower number that may hold a partner."""
        schema = pa.schema([("id", pa.int64()), ("copies", pa.int64()), ("dims", pa.int32()), ("bits", pa.binary()), ("cell", pa.int32()), ("home", pa.bool_())])
        for batch in batches(part):
            table = pa.Table.from_batches([batch])
            for dims in set(table["dims"].to_pylist()):
                own = table.filter(pa.compute.equal(table["dims"], dims))
                points, c = unit(_stack(own["bits"], dims)), shared.value.get(dims)
                c = points[:1] if c is None else c
                near = points @ c.T
                home = near.argmax(axis=1)
                gap = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
                may = near[np.arange(len(points)), home][:, None] - near <= chord * gap[home] + 1e-9
                may &= np.arange(len(c))[None, :] < home[:, None]
                r, g = np.nonzero(may)
                r, g = np.concatenate([np.arange(len(points)), r]), np.concatenate([home, g])
                at_home = np.arange(len(r)) < len(points)
                out = own.select(["id", "copies", "dims", "bits"]).take(pa.array(r))
                yield from out.append_column("cell", pa.array(g, pa.int32())).append_column("home", pa.array(at_home)).cast(schema).to_batches()

    placed = written(classes.select("id", "copies", "dims", "bits").mapInArrow(place, "id long, copies long, dims int, bits binary, cell int, home boolean"), "placed")
    # blocks of the homes, and of the guests, of each cell: at most MOST_CELLS small rows for each length
    sizes = placed.groupBy("dims", "cell").agg(F.sum(F.col("home").cast("int")).alias("n"), F.sum((~F.col("home")).cast("int")).alias("g"))
    sizes = sizes.select("dims", "cell", F.ceil(F.col("n") / block).cast("int").alias("nb"), F.ceil(F.col("g") / block).cast("int").alias("gb")).filter("nb > 0")
    cut = placed.join(sizes, ["dims", "cell"]).withColumn("h", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("nb")).otherwise(F.col("gb"))).cast("int"))
    # a base meets its own block, the home blocks after it as probes, and all blocks of guests (numbered on)
    none = F.array().cast("array<int>")
    as_base = F.concat(F.sequence("h", F.col("nb") - 1), F.when(F.col("gb") > 0, F.sequence(F.col("nb"), F.col("nb") + F.col("gb") - 1)).otherwise(none))
    bases = cut.filter("home").select("id", "copies", "dims", "bits", "cell", F.col("h").alias("base"), F.explode(as_base).alias("probe"), F.lit(True).alias("is_base"))
    of_home = F.when(F.col("h") > 0, F.sequence(F.lit(0), F.col("h") - 1)).otherwise(none)
    meets = F.when(F.col("home"), of_home).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))
    number = F.when(F.col("home"), F.col("h")).otherwise(F.col("nb") + F.col("h"))
    probes = cut.select("id", "copies", "dims", "bits", "cell", F.explode(meets).alias("base"), number.alias("probe"), F.lit(False).alias("is_base"))
    pair = ["dims", "cell", "base", "probe"]  # dealt out anew: else all blocks of a cell stay in the task of its join
    found = written(bases.unionByName(probes).repartition(*pair).groupBy(*pair).applyInArrow(_compare(cosine), "a long, b long, n long"), "found")

    joined = components(found.filter("b IS NOT NULL").select("a", "b"))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    of_class = (
        classes.select("print", "id", "copies")
        .join(counts, "id", "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("print", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    tied = rows.filter("print IS NOT NULL").select("vec_id", "print").join(of_class, "print").select("vec_id", "n_links", "component_id")
    lone = rows.filter("print IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return tied.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

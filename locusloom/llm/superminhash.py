"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

A document's set holds the hashes of its distinct word shingles. Documents of one set are folded into a class
first, so thousands of copies cost one signature. Signatures of classes are cut into bands; classes that share
a band are candidates. Every class of a band is compared with the one that shares most bands with others, which
in a group of edited copies is the original. Where a band's classes are still in several components after that,
they are compared in blocks: a task gets the full sets of two blocks, counts common shingles by an inverted list of its own, and returns a spanning forest of the
links it confirmed. So what is passed on grows with the members of a band, never with its pairs, and no link that a
band finds is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batches, bitmap, lower_words, may_hold, mixed, signed, window_hashes, word_hashes, written
from .components import components

SLOTS = 100
BLOCK = 2_048  # members of a block of a band
BLOCK_BYTES = 16 << 20  # bytes of their sets
BANDS = 20  # bands of 5: a pair at 0.85 is missed with probability (1 - 0.85 ** 5) ** 20 < 1e-5


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles; of all words as one shingle if there are fewer."""
    return np.unique(window_hashes(word_hashes(lower_words(text)), k))


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signature of a set of 64-bit hashes: ``slots`` values, each the least rank plus fraction of any element.

    Element by element, step ``j`` of a Fisher-Yates shuffle names the slot that gets rank ``j``. All elements take
    step ``j`` at once, and steps end as soon as ``j`` exceeds every slot's value: large sets need only a few. The
    swaps of a shuffle stay within its own row. Ranks of one element over the slots are a permutation, so slots
    are filled more evenly than by independent hashes, and estimates vary less.
    """
    n = len(elements)
    if n == 0:
        return np.full(slots, np.iinfo(np.uint64).max, dtype=U64)
    best = np.full(slots, np.iinfo(np.uint64).max, dtype=U64)
    state, every = elements.copy(), np.arange(n)
    place = None
    for j in range(slots):
        state = mixed(state + U64(0x9E3779B97F4A7C15))
        k = j + (state % U64(slots - j)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if place is None:  # most sets end after a few steps; only now a row of slots for each element
                place = np.tile(np.arange(slots, dtype=np.int16), (n, 1))
                place[every, first] = 0
                place[every, 0] = first
            slot = place[every, k].astype(np.int64)
            place[every, k] = place[every, j]
        # rank in the upper bits, fraction in the lower ones
        value = (U64(j) << U64(52)) | (mixed(state ^ U64(0xD6E8FEB86659FD93)) >> U64(12))
        np.minimum.at(best, slot, value)
        if int(best.max() >> U64(52)) <= j:
            break
    return best


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    rows = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    for i in range(rows.shape[1]):
        key = mixed(key ^ rows[:, i])
    return key


def _signatures(docs: DataFrame, k: int, slots: int, bands: int) -> DataFrame:
    """``doc_id, n_shingles, print`` (of the set), ``keys`` of bands. NULL for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            sizes, prints, keys = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k)
                signature = superminhash(s, slots)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(signed(band_keys(signature, bands)) if len(s) else None)
            out = [batch.column(0), *[pa.array(v, type=t.type) for v, t in zip((sizes, prints, keys), list(schema)[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, print binary, keys array<long>")


def linked_forest(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of ids that tie together what confirmed links between a left and another row tie together.

    Rows of one part are together already. A row's common shingles with all others are counted at once by an
    inverted list. Rows are taken part by part, and a row only as long as some other row lies in another tree; so a group that
    hangs together is settled after a few rows.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    elements, posting = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(posting, kind="stable")
    owners, ends = owner[order], np.concatenate([[0], np.cumsum(np.bincount(posting, minlength=len(elements)))])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    _, tree = np.unique(parts, return_inverse=True)
    right = ~left if not left.all() else left
    out = []
    for x in np.flatnonzero(left).tolist():
        if not (right & (tree != tree[x])).any():
            continue
        at = posting[begins[x] : begins[x + 1]]
        counts = ends[at + 1] - ends[at]
        places = np.repeat(ends[at] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        common = np.bincount(owners[places], minlength=n)
        linked = right & (tree != tree[x]) & (100 * common >= percent * (sizes[x] + sizes - common))
        for y in np.flatnonzero(linked).tolist():
            if tree[y] != tree[x]:
                out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
                tree[tree == tree[y]] = tree[x]
    return out


def _linked_in_blocks(percent: int):
    def run(group: pa.Table) -> pa.Table:
        left = np.array(group["left"].to_pylist(), dtype=bool)
        sets = [np.frombuffer(e.as_buffer(), dtype=U64) for e in group["elements"]]
        pairs = linked_forest(group["id"].to_numpy(), group["part"].to_numpy(), sets, left, percent)
        return pa.table([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def links_in_blocks(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` between members of one band in different parts, a forest of them for each two blocks.

    ``apart`` has ``key, id, part``, ``sets`` has ``id, elements``. Bands of the same members are taken once. A band is cut
    into blocks of at most about ``BLOCK`` members and ``BLOCK_BYTES`` of sets, by a hash of the id; each two blocks meet in a task of
    their own.
    """
    sized = apart.join(sets.select("id", F.length("elements").alias("bytes")), "id")
    h = F.xxhash64("id")
    bands = sized.groupBy("key").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y"))
    once = bands.groupBy("m", "bytes", "x", "y").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    cut = apart.join(once.select("key", blocks.alias("nb")), "key").withColumn("h", F.pmod(F.xxhash64("id"), "nb").cast("int"))
    lefts = cut.select("key", "id", "part", F.col("h").alias("i"), F.explode(F.sequence("h", F.col("nb") - 1)).alias("j"), F.lit(True).alias("left"))
    rights = cut.filter("h > 0").select("key", "id", "part", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("i"), F.col("h").alias("j"), F.lit(False).alias("left"))
    met = lefts.unionByName(rights).join(sets, "id").select("key", "i", "j", "id", "part", "left", "elements")
    return met.groupBy("key", "i", "j").applyInArrow(_linked_in_blocks(percent), "a long, b long").distinct()


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``id`` and shingle set, as sorted 64-bit hashes, of the documents named in ``ids(id)``.

    A bitmap of their ids tells where to look, so texts are not shuffled; a few sets more do no harm.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids, "id"))  # of fixed size

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            batch = batch.filter(pa.array(may_hold(wanted.value, batch.column(0).to_numpy(zero_copy_only=False))))
            sets = [shingle_set(t, k).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, type=pa.binary())], names=["id", "elements"])

    found = docs.filter("doc_id IS NOT NULL").mapInArrow(run, "id long, elements binary")
    return written(found.groupBy("id").agg(F.min("elements").alias("elements")), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have ``100 * intersection >= percent * union``; ``sets`` has ``id, elements``."""
    left, right = sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), sets.select(F.col("id").alias("b"), F.col("elements").alias("eb"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def _apart(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``key, id, part`` of the bands ``(key, id)`` whose members lie in several components."""
    placed = members.join(joined.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    split = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key")
    return written(placed.join(split, "key", "left_semi"), "apart")


def settled(members: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, component`` once every two members of a band ``(key, id)`` are linked, or found not to be.

    ``links`` hold already, ``sets`` has ``id, elements`` of all members. Bands that lie in several components after these
    links are compared in blocks.
    """
    joined = components(links)
    apart = _apart(members, joined)
    if apart.isEmpty():
        return joined
    rest = written(links_in_blocks(apart, sets, percent), "links")
    return joined if rest.isEmpty() else components(links.unionByName(rest))


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    slots: int = SLOTS,
    bands: int = BANDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are lower-cased (A-Z) and cut at ASCII white space; a text with fewer than ``words`` words is one
    shingle. Documents link if ``100 * intersection >= percent * union`` of their sets. ``component_id`` is the
    smallest id reachable; ``kept`` marks it. Empty and NULL texts, and rows without an id, link with nothing.
    Equal rows count as copies; rows of one id with different texts should not occur (they share a component).
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = written(_signatures(named, words, slots, bands), "signatures")
    fine = marks.filter("print IS NOT NULL AND doc_id IS NOT NULL")
    # a class is named by the least id of its rows
    classes = written(fine.groupBy("print").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")), "classes")
    banded = written(classes.select("id", F.explode("keys").alias("key")), "bands")
    shared = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("m")).filter("low < high").select("key", "m")
    members = written(banded.join(shared, "key"), "members")

    # the leader of a band: the class that meets most others in its bands
    wide = members.groupBy("id").agg(F.sum("m").alias("met"))
    known = members.select("key", "id").join(wide, "id")
    leaders = known.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("leader"))
    led = members.join(leaders, "key").filter("id != leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    pairs = written(led.distinct(), "pairs")
    sets = _sets_of(named, members.select("id"), words)  # every member of a band is in some pair
    links = written(confirmed(pairs, sets, percent), "links")

    joined = settled(members.select("key", "id"), links, sets, percent)

    of_class = classes.select("print", "id").join(joined.withColumnRenamed("node", "id"), "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    lone = marks.filter("print IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    tied = marks.filter("print IS NOT NULL AND doc_id IS NOT NULL").join(of_class, "print").select("doc_id", "n_shingles", "component_id")
    return tied.unionByName(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

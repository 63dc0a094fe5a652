"""Substring dedup by paragraph MinHash banding.

A paragraph here is what lies between two cuts that a text's own words decide: after the end of a line or of a
sentence, or after a word whose hash is 0 modulo ``CUT``, once ``LEAST`` words have gathered. So a passage pasted into
another text, even in the middle of its lines, soon falls into the same paragraphs as elsewhere.

Equal paragraphs share a fingerprint. Paragraphs of ``NEAR`` words or more also carry ``BANDS`` min-hashes of their
five-word shingles, each a band of its own: at Jaccard 0.8 one of them agrees with probability 1 - 0.2 ** BANDS.
(Of fewer words, 0.8 means equality, but for repeats of one word.) Paragraphs that share a band with others are joined
to the least of the band, verified on their exact shingle sets, and clustered by components. Of each cluster the
first paragraph by (document, place) stays.

Besides, windows of ``WINDOW`` words are compared wherever a window's hash is the least of ``NEXT`` that begin one after
the other. Of any ``LEAST_RUN`` equal words at least one such window is chosen, the same one wherever they stand and without any line or
sentence end. Of equal windows the first stays. Others that overlap or touch make up a stretch, whose two ends are extended word by word
as far as the text around the windows there is equal; only for these ends are words passed on.

A run of what goes is removed if it has ``LEAST_RUN`` words or more, so that a stock phrase doesn't cost a clean document
its text.

Almost all paragraphs occur once. Before each shuffle of paragraphs a bitmap of fixed size, made of the keys that do
repeat, tells which may matter; it only ever lets too many through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Laid, batches, bitmap, may_hold, mixed, signed, window_hashes, written
from .components import components
from .superminhash import confirmed, settled

SHINGLE = 5
LEAST, NEAR, LEAST_RUN = 5, 8, 20
CUT = 32
BANDS = 3
REACH = 4
WINDOW, NEXT = 11, 10  # WINDOW + NEXT - 1 = LEAST_RUN: any run that long holds a chosen window
TEXTS = 2 << 20  # bytes of texts taken at once

_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True


def paragraphs_of(laid: Laid) -> tuple[np.ndarray, np.ndarray]:
    """First word and end word of each paragraph."""
    if not len(laid.h):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    lines = np.cumsum(laid.b == 0x0A)
    last = np.append(lines[laid.starts[1:]] > lines[laid.ends[:-1] - 1], True)
    places = np.flatnonzero(last | _STOP[laid.b[laid.ends - 1]] | (laid.h % U64(CUT) == 0)) + 1
    closing = np.zeros(len(laid.h) + 1, dtype=bool)
    closing[laid.begins] = True
    cuts, at = [0], 0
    for place, closes in zip(places.tolist(), closing[places].tolist(), strict=True):
        if closes or place - at >= LEAST:
            cuts.append(place)
            at = place
    return np.array(cuts[:-1]), np.array(cuts[1:])


def paragraphs(text: str) -> tuple[np.ndarray, ...]:
    """Of each paragraph: first word, end word, first byte, end byte; and the hashes of all words."""
    laid = Laid([text])
    first, end = paragraphs_of(laid)
    return first, end, laid.starts[first], laid.ends[end - 1], laid.h


def fingerprints(first: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of the words of each paragraph in their order."""
    place = np.arange(len(h)) - np.repeat(first, end - first)
    parts = mixed(h + (place.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    return mixed(np.add.reduceat(parts, first) ^ (end - first).astype(U64)) if len(first) else np.zeros(0, U64)


def min_hashes(first: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``BANDS`` min-hashes of the shingles of each paragraph, one row each; those of fewer words are no use."""
    none = np.iinfo(np.uint64).max
    out = np.full((BANDS, len(first)), none, dtype=U64)
    if len(h) < SHINGLE:
        return out
    w = window_hashes(h, SHINGLE)
    w = np.append(w, np.full(len(h) - len(w), none, dtype=U64))
    inside = np.repeat(end, end - first) - np.arange(len(h)) >= SHINGLE
    for band in range(BANDS):
        out[band] = np.minimum.reduceat(np.where(inside, mixed(w ^ U64(0xA24BAED4963EE407 * (band + 1) % 2**64)), U64(none)), first)
        out[band] = mixed(out[band] + U64(band))
    return out


def pieces(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end word of each piece of a text whose words have the hashes ``h``, cut at words of least hash among ``REACH`` to
    either side. A helper of its own: ``equal_pieces`` compares windows."""
    least = np.ones(len(h), dtype=bool)
    for d in range(1, min(REACH, len(h) - 1) + 1):
        least[d:] &= h[d:] <= h[:-d]
        least[:-d] &= h[:-d] <= h[d:]
    places = np.flatnonzero(least) + 1
    if len(places) > 1 and np.diff(places).min() <= REACH:  # equal words near each other
        kept = [int(places[0])]
        for place in places.tolist():
            if place - kept[-1] > REACH:
                kept.append(place)
        places = np.array(kept)
    cuts = np.concatenate([[0], places[places < len(h)], [len(h)]]) if len(h) else np.zeros(1, dtype=np.int64)
    return cuts[:-1], cuts[1:]


def anchors(laid: Laid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the chosen windows, their hashes, and the numbers of their texts."""
    h, size = laid.h, np.diff(laid.begins)
    if len(h) < LEAST_RUN or size.max() < LEAST_RUN:
        z = np.zeros(0, dtype=np.int64)
        return z, np.zeros(0, U64), z
    g = window_hashes(h, WINDOW)
    least = g[: len(h) - LEAST_RUN + 1].copy()
    for d in range(1, NEXT):
        np.minimum(least, g[d : d + len(least)], out=least)
    left = np.repeat(laid.begins[1:], size) - np.arange(len(h))  # words from here to the text's end
    least[left[: len(least)] < LEAST_RUN] = 0  # no such row of windows in one text
    most = np.zeros(len(g), dtype=U64)
    for d in range(NEXT):
        np.maximum(most[d : d + len(least)], least, out=most[d : d + len(least)])
    at = np.flatnonzero((most == g) & (most > 0))
    return at, g[at], laid.text_of(at)


def _spot(doc, lo):
    """A number for a place in a document, from columns or from arrays; other places may have the same."""
    if isinstance(doc, np.ndarray):
        return (doc & ((1 << 40) - 1)) * 40_503 + lo * 2_654_435
    return doc.bitwiseAND(F.lit((1 << 40) - 1)) * 40_503 + lo.cast("long") * 2_654_435


def _same(x: bytes, y: bytes) -> int:
    """How many words agree from the first on."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(np.frombuffer(x[:n], np.uint32) != np.frombuffer(y[:n], np.uint32))
    return int(differ[0]) if len(differ) else n // 4


def _extended(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first (``side`` 0) or last window of each stretch, made as long as the words beside it and beside what stays are equal."""
    names = ["doc_id", "stretch", "lo", "hi", "start", "end"]
    for batch in batches(rows):
        col = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        col["hi"] = [lo + WINDOW for lo in col["lo"]]
        for i in range(batch.num_rows):
            if col["side"][i]:
                if n := _same(col["after"][i], col["kept_after"][i]):
                    col["hi"][i] += n
                    col["end"][i] = int(np.frombuffer(col["ends"][i], np.int32)[n - 1])
            else:
                n = _same(col["before"][i], col["kept_before"][i])
                if col["doc_id"][i] == col["kept"][i]:  # what stays is not touched
                    n = min(n, col["lo"][i] - col["kept_lo"][i] - WINDOW)
                if n:
                    col["lo"][i] -= n
                    col["start"][i] = int(np.frombuffer(col["starts"][i], np.int32)[n - 1])
        yield pa.RecordBatch.from_arrays([pa.array(col[n], pa.int64() if n == "doc_id" else pa.int32()) for n in names], names=names)


def _hot_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, lo, print`` of the chosen windows that may occur twice."""

    def prints(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, TEXTS):
            _, found, _ = anchors(Laid(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(signed(found))], names=["print"])

    repeated = docs.mapInArrow(prints, "print long").groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(repeated, "print"))  # of fixed size

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, TEXTS):
            laid = Laid(batch.column(1).to_pylist())
            at, found, text = anchors(laid)
            own = may_hold(wanted.value, found)
            at, text = at[own], text[own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array((at - laid.begins[text]).astype(np.int32)), pa.array(signed(found[own]))], names=["doc_id", "lo", "print"])

    return docs.mapInArrow(run, "doc_id long, lo int, print long")


def _around(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """``doc_id, lo, start, end, before, after, starts, ends`` of the chosen windows at ``spots(spot)``: characters, and up to
    ``NEXT - 1`` words to either side, the nearest first. Where more words are equal another chosen window begins among them."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(spots, "spot"))  # of fixed size
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int32()) for c in ("lo", "start", "end")], *[(c, pa.binary()) for c in ("before", "after", "starts", "ends")]])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, TEXTS):
            doc, laid = batch.column(0).to_numpy(), Laid(batch.column(1).to_pylist())
            at, _, text = anchors(laid)
            own = may_hold(wanted.value, _spot(doc[text], at - laid.begins[text]))
            at, text = at[own], text[own]
            if not len(at):
                continue
            begins, (chars, before) = laid.begins, laid.chars()
            begin, end = (chars[laid.starts] - 1).astype(np.int32), chars[laid.ends - 1].astype(np.int32)
            words, base = laid.h.astype(np.uint32), before[text].astype(np.int32)
            out = [[], [], [], []]
            for lo, low, high, less in zip(at.tolist(), np.maximum(at - NEXT + 1, begins[text]).tolist(), np.minimum(at + LEAST_RUN, begins[text + 1]).tolist(), base.tolist(), strict=True):
                hi = lo + WINDOW
                for col, v in zip(out, (words[low:lo][::-1], words[hi:high], begin[low:lo][::-1] - np.int32(less), end[hi:high] - np.int32(less)), strict=True):
                    col.append(v.tobytes())
            cols = [doc[text], (at - begins[text]).astype(np.int32), begin[at] - base, end[at + WINDOW - 1] - base, *out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    found = docs.mapInArrow(run, "doc_id long, lo int, start int, end int, before binary, after binary, starts binary, ends binary")
    return written(found.dropDuplicates(["doc_id", "lo"]), "around")


def equal_pieces(docs: DataFrame) -> DataFrame:
    """``doc_id, lo, hi, start, end, kept`` of each stretch of which every window is repeated: words, characters, and a document that
    keeps one of its windows; one row for each of these."""
    hot = written(_hot_windows(docs), "hot_windows")
    place = F.struct("doc_id", "lo")
    kept = hot.groupBy("print").agg(F.min(place).alias("kept"), F.max(place).alias("other")).filter("kept != other").select("print", "kept")
    # a window of the same document is gone only if it doesn't overlap the one that stays
    met = hot.join(written(kept, "kept_windows"), "print").filter(f"doc_id != kept.doc_id OR lo >= kept.lo + {WINDOW}")
    gone = met.select("doc_id", "lo", F.col("kept.doc_id").alias("kept"), F.col("kept.lo").alias("kept_lo"))
    order = Window.partitionBy("doc_id").orderBy("lo")
    begins = F.coalesce((F.col("lo") > F.lag("lo").over(order) + WINDOW).cast("int"), F.lit(1))
    numbered = gone.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    window = F.struct("lo", "kept", "kept_lo")
    ends = numbered.groupBy("doc_id", "stretch").agg(F.min(window).alias("first"), F.max(window).alias("last"), F.collect_set("kept").alias("keep"))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), *[F.col(f"{w}.{c}").alias(c) for c in ("lo", "kept", "kept_lo")]) for i, w in enumerate(("first", "last"))])
    stretches = written(ends.select("doc_id", "stretch", "keep", sides.alias("sides")), "stretches")
    ends = stretches.select("doc_id", "stretch", F.explode("sides").alias("s")).select("doc_id", "stretch", "s.*")
    spots = ends.select(F.explode(F.array(_spot(F.col("doc_id"), F.col("lo")), _spot(F.col("kept"), F.col("kept_lo")))).alias("spot"))
    around = _around(docs, spots)
    stays = around.select(F.col("doc_id").alias("kept"), F.col("lo").alias("kept_lo"), F.col("before").alias("kept_before"), F.col("after").alias("kept_after"))
    long = ends.join(around, ["doc_id", "lo"]).join(stays, ["kept", "kept_lo"])
    long = long.mapInArrow(_extended, "doc_id long, stretch int, lo int, hi int, start int, end int")
    whole = long.groupBy("doc_id", "stretch").agg(*[f(c).alias(c) for c, f in (("lo", F.min), ("hi", F.max), ("start", F.min), ("end", F.max))])
    return whole.join(stretches.select("doc_id", "stretch", "keep"), ["doc_id", "stretch"]).select("doc_id", "lo", "hi", "start", "end", F.explode("keep").alias("kept"))


def paragraph_table(docs: DataFrame) -> DataFrame:
    """``doc_id, place, first, words, start, end, print, keys`` of all paragraphs of ``docs(doc_id, text)``.

    ``start`` and ``end`` count characters (code points), ``first`` the words before the paragraph.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("place", pa.int32()), ("first", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("print", pa.int64()), ("keys", pa.list_(pa.int64()))]
    )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, TEXTS):
            laid = Laid(batch.column(1).to_pylist())
            first, end = paragraphs_of(laid)
            if not len(first):
                continue
            n, h, text = end - first, laid.h, laid.text_of(first)
            chars, before = laid.chars()
            # characters before the paragraph's first byte, and up to its last
            start, stop = chars[laid.starts[first]] - 1 - before[text], chars[laid.ends[end - 1] - 1] - before[text]
            place = np.arange(len(first)) - np.searchsorted(text, text)
            offsets = np.concatenate([[0], np.cumsum(np.where(n >= NEAR, BANDS, 0))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(min_hashes(first, end, h).T[n >= NEAR].ravel())))
            cols = [place, first - laid.begins[text], n, start, stop, signed(fingerprints(first, end, h))]
            cols = [pa.array(c.astype(t.type.to_pandas_dtype())) for c, t in zip(cols, list(schema)[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *cols, keys], schema=schema)

    return docs.mapInArrow(run, "doc_id long, place int, first int, words int, start int, end int, print long, keys array<long>")


def _of_bitmap(table: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Rows whose long column may be in the bitmap."""
    shared = table.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                yield batch.filter(pa.array(may_hold(shared.value, batch.column(column).to_numpy(zero_copy_only=False))))

    return table.mapInArrow(run, table.schema)


def near_clusters(docs: DataFrame, table: DataFrame, percent: int = 80) -> DataFrame:
    """``node, component`` of fingerprints of different paragraphs that verified links of ``percent`` connect."""
    keyed = table.filter(F.size("keys") > 0).select(F.explode("keys").alias("key"), "print")
    # bands with two different paragraphs; equal ones fold before the shuffle
    shared = written(keyed.groupBy("key").agg(F.min("print").alias("least"), F.max("print").alias("most")).filter("least < most").select("key", "least"), "shared")
    members = written(_of_bitmap(keyed, "key", bitmap(shared, "key")).distinct().join(shared, "key"), "members")
    pairs = written(members.filter("print != least").select(F.col("least").alias("a"), F.col("print").alias("b")).distinct(), "pairs")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(members, "print"))

    def sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, TEXTS):
            laid = Laid(batch.column(1).to_pylist())
            (first, end), h = paragraphs_of(laid), laid.h
            if not len(first):
                continue
            prints = fingerprints(first, end, h)
            own = np.flatnonzero((end - first >= NEAR) & may_hold(wanted.value, prints))
            w = window_hashes(h, SHINGLE)
            ids = signed(prints[own]).tolist()
            elements = [np.unique(w[lo : hi - SHINGLE + 1]).tobytes() for lo, hi in zip(first[own].tolist(), end[own].tolist(), strict=True)]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(elements, pa.binary())], names=["id", "elements"])

    found = written(docs.mapInArrow(sets, "id long, elements binary").groupBy("id").agg(F.min("elements").alias("elements")), "sets")
    links = written(confirmed(pairs, found, percent), "links")
    # the two of a band of two have been compared already
    wide = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 2").select("key")
    return settled(members.join(wide, "key", "left_semi").select("key", F.col("print").alias("id")), links, found, percent)


def repeated_passages(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages to remove: ``doc_id, start, end, words, paragraphs, kept_in``, one row for each run.

    ``start`` and ``end`` are places in the text in characters, ``paragraphs`` counts the paragraphs and stretches of equal windows in the run,
    ``kept_in`` lists the documents that keep them. NULL and empty texts have none; rows without an id are left alone. Ids should be unique; equal rows of
    one id count as one document.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    table = written(paragraph_table(named), "paragraphs")
    repeated = written(table.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"), "repeated")
    clusters = written(near_clusters(named, table, percent).toDF("print", "cluster"), "clusters")
    of_print = written(repeated.join(clusters, "print", "full_outer").select("print", F.coalesce("cluster", "print").alias("cluster")), "of_print")
    narrow = table.select("doc_id", "place", "first", "words", "start", "end", "print")
    hot = _of_bitmap(narrow, "print", bitmap(of_print, "print")).join(of_print, "print").dropDuplicates(["doc_id", "place"])
    hot = written(hot, "hot")
    keeper = written(hot.groupBy("cluster").agg(F.min(F.struct("doc_id", "place")).alias("keeper")), "keeper")
    gone = hot.join(keeper, "cluster").filter(F.struct("doc_id", "place") != F.col("keeper"))
    gone = gone.select("doc_id", F.col("first").alias("lo"), (F.col("first") + F.col("words")).alias("hi"), "start", "end", F.col("keeper.doc_id").alias("kept"))
    order = Window.partitionBy("doc_id").orderBy("lo", "hi")  # paragraphs and stretches of one document
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = gone.unionByName(equal_pieces(named)).withColumn("begins", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1)))
    runs = begins.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy("doc_id", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("hi") - F.min("lo")).cast("long").alias("words"), F.count("*").alias("paragraphs"), F.sort_array(F.collect_set("kept")).alias("kept_in"))
        .filter(F.col("words") >= LEAST_RUN)
        .drop("run")
    )


def without_passages(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages cut out of their texts; other columns and untouched texts stay as they are."""
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut")).withColumnRenamed("doc_id", "_cut_id")
    joined = docs.join(spans, docs[id_col].cast("long") == F.col("_cut_id"), "left")
    # what stands before the first, between, and after the last passage
    text = F.col(text_col)
    starts = F.concat(F.array(F.lit(0)), F.transform("_cut", lambda c: c["end"]))
    ends = F.concat(F.transform("_cut", lambda c: c["start"]), F.array(F.length(text)))
    rest = F.array_join(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: F.substring(text, p["s"] + 1, p["e"] - p["s"])), "")
    return joined.select(*[F.when(F.col("_cut").isNull(), text).otherwise(rest).alias(c) if c == text_col else docs[c] for c in docs.columns])

"""Token ids as bit planes or byte planes in compressed blocks, with a chunk index.

Format. The store is a Parquet table, so any file system Spark knows will do and a lost task
is written anew. One row is a segment of whole documents:

``part, segment``      order of the segments; documents ascend by id through all of them
``start_in_part``      ids in the earlier segments of the part
``doc_ids, doc_sizes`` the documents of the segment and how many ids each has
``blocks``             chunk index: for each block of ``BLOCK`` ids (the last is shorter) its number of
                       ids, the byte where it begins in ``payload``, and the length of each plane
``payload``            the planes of all blocks, one zstandard frame each

A plane holds, for every id of the block, one byte (``byte``) or one bit (``bit``) of the same
weight, lowest first; planes of zeros alone are left out at the top.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, batches, byte_stand_ins

BLOCK = 65_536
SEGMENT = 1_000_000
LEVEL = 3

STORE = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("start_in_part", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_sizes", pa.list_(pa.int64())),
        ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("at", pa.int64()), ("planes", pa.list_(pa.int32()))]))),
        ("planes", pa.string()),
        ("payload", pa.binary()),
    ]
)
STORE_DDL = (
    "part int, segment int, start_in_part long, n_ids long, doc_ids array<long>, doc_sizes array<long>,"
    " blocks array<struct<n: int, at: long, planes: array<int>>>, planes string, payload binary"
)


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest weight first, without zero planes at the top."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if planes == "byte":
        cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [cells[:, i].tobytes() for i in range((top + 7) // 8)]
    if planes == "bit":
        return [np.packbits(((ids >> np.uint32(i)) & np.uint32(1)).astype(np.uint8)).tobytes() for i in range(top)]
    raise ValueError(f"planes: {planes!r} is neither 'byte' nor 'bit'")


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    ids = np.zeros(n, dtype=np.uint32)
    for i, part in enumerate(parts):
        if planes == "byte":
            ids |= np.frombuffer(part, dtype=np.uint8).astype(np.uint32) << np.uint32(8 * i)
        else:
            ids |= np.unpackbits(np.frombuffer(part, dtype=np.uint8), count=n).astype(np.uint32) << np.uint32(i)
    return ids


def pack_ids(ids: np.ndarray, planes: str = "byte", block: int = BLOCK) -> tuple[list[dict], bytes]:
    """Chunk index and payload of one segment."""
    squeeze, index, out, at = zstandard.ZstdCompressor(level=LEVEL), [], [], 0
    for lo in range(0, len(ids), block):
        part = ids[lo : lo + block]
        frames = [squeeze.compress(p) for p in to_planes(part, planes)]
        index.append({"n": len(part), "at": at, "planes": [len(f) for f in frames]})
        out += frames
        at += sum(map(len, frames))
    return index, b"".join(out)


def unpack_block(payload: bytes, entry: dict, planes: str) -> np.ndarray:
    """The ids of one block, found by its entry of the index."""
    loosen, at, parts = zstandard.ZstdDecompressor(), entry["at"], []
    for size in entry["planes"]:
        parts.append(loosen.decompress(payload[at : at + size]))
        at += size
    return from_planes(parts, entry["n"], planes)


def unpack_ids(payload: bytes, index: list[dict], planes: str) -> np.ndarray:
    found = [unpack_block(payload, e, planes) for e in index]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


_ENCODERS: dict = {}


class WordEncoder:
    """Ids of a text by a lower-casing tokenizer whose words end at white space.

    White space is dropped by its pre-tokenizer and no word of it crosses white space, so a text's ids
    are those of its white-space runs in a row; runs are remembered. Its normaliser (NFC, lower case)
    does to Latin-1 text just what ``str.lower`` does, so such texts are lowered at once and their runs,
    mostly plain letters, go to the model itself; runs of other texts take the whole tokenizer. Texts with
    a string that the tokenizer treats as one special token, or with a separator (U+001C to U+001F) that
    Python's split counts as white space and the tokenizer doesn't, are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        self.odd = [a["content"] for a in added] + [chr(c) for c in range(0x1C, 0x20)]
        self.letters = str.maketrans({chr(b): c for c, b in byte_stand_ins().items()})
        self.lowered, self.others = Memo(self._lowered, limit=600_000), Memo(self._whole, limit=100_000)

    def _whole(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _lowered(self, run: str) -> bytes:
        if run.isalpha():
            found = self.model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(self.letters))
            return np.array([t.id for t in found], dtype="<u4").tobytes()
        if run[:-1].isalpha() and run[-1] in ",.;:!?":
            return self.lowered[run[:-1]] + self.lowered[run[-1]]
        return self._whole(run)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.odd):
            return self._whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.others.__getitem__, text.split()))
        return b"".join(map(self.lowered.__getitem__, text.lower().split()))


def encoder_of(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_planes(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    end_id: int = 1,
    planes: str = "byte",
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    segment: int = SEGMENT,
    encoder: Callable[[str], WordEncoder] = encoder_of,
) -> None:
    """Encode all texts, append ``end_id`` to each, and store the ids in ascending document order.

    Texts are range-partitioned by id before they are encoded, so encoding runs once and ids are never
    shuffled. A NULL or empty text gives the end id alone. Rows without an id come first; rows of one
    id follow each other by text, so a repeated run writes the same store. Other columns are ignored.
    """

    def store(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, number, done = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, sizes, held = [], [], [], 0

        def flush():
            nonlocal number, done, held
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            index, payload = pack_ids(flat, planes, block)
            row = [part, number, done, len(flat), list(doc_ids), list(sizes), index, planes, payload]
            number, done, held = number + 1, done + len(flat), 0
            for x in (ids, doc_ids, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], type=t.type) for v, t in zip(row, STORE, strict=True)], schema=STORE)

        for batch in batches(rows):
            found = map(encode, batch.column(1).to_pylist())
            for doc, got in zip(batch.column(0).to_pylist(), found, strict=True):
                ids.append(got + end)
                doc_ids.append(doc)
                sizes.append(len(got) // 4 + 1)
                held += sizes[-1]
                if held >= segment:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    ordered.mapInArrow(store, STORE_DDL).write.parquet(path)


def read_planes(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row per stored document: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids`` (32-bit).

    ``start`` counts the ids of all documents before it; the CRC-32 is that of its ids, read back from
    the planes, as little-endian unsigned 32-bit integers. An empty store gives no row.
    """
    fields = [("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def load(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for row in batch.to_pylist():
                raw = unpack_ids(row["payload"], row["blocks"], row["planes"]).astype("<u4").tobytes()
                ends = np.cumsum(row["doc_sizes"])
                starts = ends - row["doc_sizes"]
                bits = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                got = [[row["part"]] * len(bits), starts + row["start_in_part"], row["doc_ids"], row["doc_sizes"], [zlib.crc32(b) for b in bits]]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t.type) for v, t in zip(got + [bits] * with_ids, schema, strict=True)], schema=schema)

    store = spark.read.schema(STORE_DDL).parquet(path)
    # one row per part, however many documents there are
    totals = store.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("all_ids").over(before), F.lit(0)).alias("base"))
    docs = store.mapInArrow(load, "part int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return docs.join(bases, "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

"""What several operators share: words, word hashes, columns of batches, scratch tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

U64 = np.uint64
BITMAP_BITS = 26


def workers_find_package(spark: SparkSession) -> None:
    """Python workers that share this checkout import it from here, wherever the driver was started.

    Elsewhere the package is installed or shipped with ``--py-files``; the path is then merely absent.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of the shared folder: cuts lineage, computes the plan once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Memo(dict):
    """Remembers ``make(key)``; emptied when it holds ``limit`` keys, so memory is bounded."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def byte_stand_ins() -> dict[str, int]:
    """Byte of each character of byte-level BPE: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_HASHES = Memo(xxhash.xxh3_64_intdigest)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (``bytes.split`` cuts at just these bytes)."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case (``bytes.lower`` touches ASCII only)."""
    return text.encode().lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(_HASHES.__getitem__, found), dtype=U64, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; of the whole run if it is shorter; none if there is no word."""
    n = len(h)
    if n == 0:
        return h
    size = min(n, k)
    out = np.full(n - size + 1, size, dtype=U64)
    for i in range(size):
        out = (out ^ h[i : n - size + 1 + i]) * U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
    return mixed(out)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, eight bytes at a time. Spans of one length of up to eight bytes never collide."""
    size = ends - starts
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(b) + 1, dtype="<u8", buffer=padded, strides=(1,))
    h, rest, own, at = size.astype(U64) * U64(0x9E3779B97F4A7C15), size, None, starts
    while len(at):
        part = eight[at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (U64(8) - np.minimum(rest, 8).astype(U64))))
        mine = mixed((h if own is None else h[own]) ^ part)
        h = mine if own is None else h
        if own is not None:
            h[own] = mine
        more = np.flatnonzero(rest > 8)
        own = more if own is None else own[more]
        at, rest = at[more] + 8, rest[more] - 8
    return h


class Laid:
    """Texts in a row, a line end between them: bytes ``b`` (``low``: A-Z in lower case), first and end byte of each word, the hashes
    ``h`` of the words in lower case, and at which word each text begins (and the last one ends)."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        joined = b"\n".join(raw)
        self.b = np.frombuffer(joined, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[self.b].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.low = joined.lower()
        self.h = span_hashes(np.frombuffer(self.low, dtype=np.uint8), self.starts, self.ends)
        self.at = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.begins = np.searchsorted(self.starts, self.at)

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters up to each byte, and before each text."""
        chars = np.cumsum((self.b & 0xC0) != 0x80)
        return chars, np.concatenate([[0], chars])[self.at[:-1]]

    def text_of(self, word: np.ndarray) -> np.ndarray:
        """The number of the text that a word is in."""
        return np.searchsorted(self.begins, word, side="right") - 1


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the bits of Spark's long."""
    return h.view(np.int64)


def batches(rows: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes (one row at least)."""
    for batch in rows:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Bits of ``2 ** BITMAP_BITS`` slots, set where the low bits of a column (long) fall: 8 MB, whatever the input.

    The more values there are, the more others share their slots; so it only thins out what is shuffled next.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1
    buckets = values.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    out = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for r in buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():
        bits = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        at = (r.bucket - 1) * len(bits)
        out[at : at + len(bits)] = bits
    return out


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """False only for 64-bit values that the bitmap was not made of."""
    slot = values.view(U64) & U64((1 << BITMAP_BITS) - 1)
    return (bits[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1
